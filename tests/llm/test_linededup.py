import random

import pytest
from pyspark.sql import functions as F

from chalkline.llm import linededup
from tests.llm.conftest import docs_frame, with_clashes


def word_sets(rows):
    out = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            for c in "\t\r\f\v":
                line = line.replace(c, " ")
            out.append((d, i, frozenset(w for w in line.lower().split(" ") if w)))
    return out


def gone_lines(rows, num=4, den=5):
    lines, gone = word_sets(rows), set()
    for k, (d, i, s) in enumerate(lines):
        if s and any(len(s & o) * den >= len(s | o) * num for _, _, o in lines[:k] if o):
            gone.add((d, i))
    return gone


def texts(rows, gone):
    return sorted((str(d), None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows)


def check(spark, rows, num=4, den=5):
    df = with_clashes(docs_frame(spark, rows)).repartition(3)
    out = linededup.dedup_lines(df, num / den)
    got = out.collect()
    gone = gone_lines(rows, num, den)
    assert sorted((str(r.doc_id), r.text) for r in got) == texts(rows, gone)
    for r in got:
        assert r.lines == (0 if r.text is None else len(dict(rows)[r.doc_id].split("\n")))
        assert r.removed_lines == sum(d == r.doc_id for d, _ in gone)
    assert out.columns == [*df.columns, "lines", "removed_lines"]


@pytest.mark.parametrize("ratio", [(4, 5), (3, 5), (1, 1)])
def test_matches_brute_force(spark, ratio):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    lines = [rng.choices(vocabulary, k=rng.randint(1, 14)) for _ in range(40)]
    rows = []
    for d in range(60):
        body = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(lines))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            body.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((d, "\n".join(body)))
    check(spark, rows, *ratio)


def test_near_copies_of_a_long_line(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for d in range(40):
        line = list(base)
        for _ in range(rng.randint(0, 16)):
            line[rng.randrange(120)] = f"new{rng.randrange(1000)}"
        rows.append((d, " ".join(line)))
    check(spark, rows)


def test_messy(spark):
    rows = [(1, "Same line here\nother"), (2, None), (3, ""), (4, "same LINE  here\n\n\nlast"), (None, "same line here"), (5, "\n"),
            (6, "word " * 5_000 + "\nother\r"), (7, "x" * 50_000), (8, "OTHER"), (9, "a b c d e"), (10, "a b c d"), (11, "長い 行 です"), (12, "長い 行 です")]
    check(spark, rows)


def test_repeated_rows_keep_one_copy(spark, empty_docs):
    rows = [(1, "one line of words"), (1, "one line of words"), (2, "one line of words\nand one more"), (2, "zzz"),
            (None, "said without an id"), (None, "said without an id"), (None, None), (2, "zzz")]
    out = [(r.doc_id, r.text, r.removed_lines) for r in linededup.dedup_lines(with_clashes(docs_frame(spark, rows))).collect()]
    assert sorted(out, key=str) == sorted([
        (1, "one line of words", 0), (1, "", 1), (2, "and one more", 1), (2, "zzz", 0), (2, "", 1),
        (None, "said without an id", 0), (None, "", 1), (None, None, 0)], key=str)
    assert linededup.dedup_lines(empty_docs).count() == 0


def test_parity_widths(spark):
    """Near copies whose lengths lie on both sides of the widths' bounds, and long lines that only share rare words."""
    rng = random.Random(10)
    rows = []
    for d, n in enumerate([99, 100, 110, 399, 400, 430, 1_200]):
        base = [f"b{d}x{i}" for i in range(n)]
        rows += [(4 * d, " ".join(base)), (4 * d + 1, " ".join(base[:-3])), (4 * d + 2, " ".join([*base[: n * 9 // 10], f"own{d}"])),
                 (4 * d + 3, " ".join([*rng.sample(base, n // 2), *(f"else{d}x{i}" for i in range(n // 2))]))]
    check(spark, rows)


def test_texts_under_one_id_are_judged_each_by_itself(spark):
    rows = [(1, "one line of words"), (2, "one line of words\nand one more"), (2, "zzz"), (None, "first without id\nits own end"),
            (None, "second without id\nand one more"), (None, "common to both of them"), (None, "common to both of them\nlast of all")]
    out = {(r.doc_id, r.text) for r in linededup.dedup_lines(with_clashes(docs_frame(spark, rows)).repartition(3)).collect()}
    # a null id comes first; only lines that an earlier row has go, never another row's line at the same number
    assert {(1, "one line of words"), (2, ""), (2, "zzz"), (None, "first without id\nits own end"),
            (None, "second without id\nand one more")} <= out
    ends = [t for d, t in out if d is None and t not in ("first without id\nits own end", "second without id\nand one more")]
    assert sorted(ends) in (["", "common to both of them\nlast of all"], ["common to both of them", "last of all"])


def test_native_plan(spark, sample):
    plan = linededup.dedup_lines(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F.col  # DataFrame functions only


def test_generated_documents(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.text) for r in linededup.dedup_lines(sample).collect())
    assert got == texts(rows, gone_lines(rows))


def candidates(spark, monkeypatch, rows):
    """Pairs of lines that the join of the posting lists finds (the frame with their distance in parity bits)."""
    counts, stored = [], linededup.materialize

    def watched(df):
        out = stored(df)
        if {"off", "ad", "bd"} <= set(out.columns):
            counts.append(out.count())
        return out
    monkeypatch.setattr(linededup, "materialize", watched)
    check(spark, rows)
    return counts[0]


def test_a_group_of_near_copies_is_not_paired_with_itself(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for d in range(240):
        line = list(base)
        for at in rng.sample(range(60), rng.randint(0, 4)):
            line[at] = f"new{rng.randrange(3_000)}"
        rows.append((d, " ".join(line)))
    assert candidates(spark, monkeypatch, rows) < 10 * len(rows)


def test_unlike_lines_that_share_a_rare_word_are_told_apart_by_their_bits(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(1_500)]
    rows = [(d, " ".join(["rare", *rng.sample(vocabulary, 94)])) for d in range(250)]
    assert candidates(spark, monkeypatch, rows) < 10


def test_the_join_of_posting_lists_is_compiled_and_reads_one_exchange(spark, sample, monkeypatch):
    """Its condition once asked array functions, which Spark only interprets: most of the query's CPU time."""
    plans, stored = [], linededup.materialize

    def watched(df):
        if {"off", "ad", "bd"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df)
    monkeypatch.setattr(linededup, "materialize", watched)
    linededup.dedup_lines(sample)
    joins = [line for line in plans[0].splitlines() if "SortMergeJoin" in line]
    assert joins and not any(f in line for line in joins for f in ("lambda", "zip_with", "aggregate("))
    # the index side's filter stays above the exchange of the posting rows
    lines = plans[0].splitlines()
    at = next(i for i, line in enumerate(lines) if "SPARK_PARTITION_ID" in line)
    assert "REPARTITION_BY_COL" in lines[at + 1]


def test_equal_lengths_and_lengths_apart_meet_by_the_short_prefix(spark):
    """Pairs right at the threshold, the shorter one earlier or later, or both equally long."""
    rows = []
    for k, (n, m, shared) in enumerate([(8, 10, 8), (10, 8, 8), (9, 9, 8), (40, 50, 40), (50, 40, 40), (45, 45, 40), (160, 200, 160), (200, 160, 160), (9, 9, 7), (40, 51, 40)]):
        both = [f"c{k}x{i}" for i in range(shared)]
        rows += [(2 * k, " ".join([*both, *(f"a{k}x{i}" for i in range(n - shared))])), (2 * k + 1, " ".join([*(f"b{k}x{i}" for i in range(m - shared)), *both]))]
    assert len(gone_lines(rows)) == 8
    check(spark, rows)
