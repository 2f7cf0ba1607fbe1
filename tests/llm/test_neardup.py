import re

import pytest
import xxhash

from chalkline.llm import neardup
from chalkline.llm.links import signed
from tests.llm.conftest import docs_frame, with_clashes
from tests.llm.test_fingerprint import bits, groups


def plain_fingerprint(text):
    """The contract's words, step by step."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return signed(sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    nodes = set(fps)
    root = groups([(a, b) for a in nodes for b in nodes if a < b and bits(a, b) <= 2], nodes)
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return sorted((str(d), f, least.get(root[f])) for (d, _), f in zip(rows, fps))


@pytest.mark.parametrize("source", ["sample", "messy"])
def test_matches_brute_force(spark, request, source):
    docs = request.getfixturevalue(source)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in neardup.near_duplicates(docs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in brute(rows)]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a b c",), ("wörd élan ß",)], "s string")
    for r in df.select("s", F.xxhash64("s").alias("h")).collect():
        assert r.h == signed(xxhash.xxh64_intdigest(r.s.encode(), 42))


def test_long_text_in_chunks(monkeypatch):
    text = ("some words that go on " * 400).encode()
    whole = neardup.fingerprint(text)
    monkeypatch.setattr(neardup, "CHUNK", 7)
    assert neardup.fingerprint(text) == whole


def test_keep_first(spark, empty_docs):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(3, text), (1, text), (2, text + " more"), (9, "something else entirely here"), (4, None), (5, ""), (None, text), (9, "something else entirely here")]
    kept = neardup.keep_first(with_clashes(docs_frame(spark, rows)))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 9]
    assert kept.columns == with_clashes(docs_frame(spark, rows)).columns
    assert neardup.keep_first(empty_docs).count() == 0
    # documents without an id stay where no other is near
    lone = neardup.keep_first(docs_frame(spark, [(None, "nobody else says this"), (1, "another thing is said here")]))
    assert lone.count() == 2


def test_keep_first_under_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(9, a), (9, a), (9, b), (None, c), (None, c), (None, a), (None, None), (None, "")]
    kept = neardup.keep_first(docs_frame(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("9", a), ("9", b), ("None", c), ("None", "")])
