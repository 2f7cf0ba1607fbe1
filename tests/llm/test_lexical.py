import math
import re
from collections import Counter

import numpy as np
import pytest

from chalkline.llm import lexical
from tests.llm.conftest import MESSY, SCHEMA, docs_frame, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in items:
        rows = []
        for d, c, n in found:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                rows.append((-score, d is None, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return sorted(out, key=repr)


def search(spark, docs, items, k=3, **more):
    df = with_clashes(docs_frame(spark, docs).withColumnRenamed("n_chars", "tf"))
    return sorted((tuple(r) for r in lexical.search(df, with_clashes(spark.createDataFrame(items, ITEMS)), k, **more).collect()), key=repr)


@pytest.mark.parametrize("tile_docs, lead, batch_terms", [(2, 1, 5), (3, 2, 10**6), (4096, 3, 10**6)])
def test_messy_ties_and_nulls(spark, tile_docs, lead, batch_terms):
    docs = [r[:2] for r in MESSY] + [(100 + i, "equal words in every copy") for i in range(25)] + [(None, "equal words in every copy")] * 2
    items = [(1, "the Fox and the DOG, one"), (2, "equal copy"), (3, None), (4, "!!"), (5, "unseen words0"), (6, "wörd ÑANDÚ ñandú 長い文章 𝒜"),
             (6, "text"), (None, "word x under"), (7, "1234")]
    assert search(spark, docs, items, 3, tile_docs=tile_docs, lead=lead, batch_terms=batch_terms) == brute(docs, items, 3)


def test_whole_small_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert search(spark, docs, items, 10, tile_docs=16) == brute(docs, items, 10)


def test_bounds_hold_and_prune():
    """No document scores above its stratum's bound, and a floor leaves strata out."""
    rng = np.random.default_rng(5)
    import pyarrow as pa
    n = rng.integers(1, 60, 400)
    terms_, tfs = [], []
    for size in n:
        c = Counter(rng.integers(0, 30, size).tolist())
        terms_.append(list(c))
        tfs.append(list(c.values()))
    table = pa.table({"doc_id": pa.array(range(400), pa.int64()), "m": pa.array((10 + 3 * n).tolist(), pa.int64()),
                      "terms": pa.array(terms_, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})
    tile = lexical._index_tile((pa.scalar(0),), table)
    places = {str(i).encode(): i for i in range(30)}
    asked = lexical.Queries([(0, [b"1", b"2", b"3"]), (1, [b"7"])], places, np.arange(30, dtype=np.int64) * 100 + 50)
    found = lexical.Tile(tile["index"][0].as_py(), asked)
    bounds = found.bounds()
    for i, wanted in enumerate(([1, 2, 3], [7])):
        scores = np.array([sum((t * 100 + 50) * (10**9 * f // (1000 * f + 8 * (10 + 3 * int(s)))) for t, f in zip(ts, fs) if t in wanted)
                           for ts, fs, s in zip(terms_, tfs, n)])
        stratum = np.searchsorted(found.m, 10 + 3 * n)
        assert (scores <= bounds[stratum, i]).all()
        [(_, docs, best)] = list(found.search(np.array([i]), 5))
        assert sorted(best.tolist(), reverse=True) == sorted(scores.tolist(), reverse=True)[:5]
        assert (bounds[:, i] < best.min()).any()
        assert (np.sort(found.ids[docs]) == np.sort(np.lexsort((np.arange(400), -scores))[:5])).all()


def test_empty(spark, empty_docs):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    out = lexical.search(empty_docs, items)
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    none = lexical.search(docs_frame(spark, [(1, "a")]), spark.createDataFrame([], ITEMS))
    assert none.count() == 0 and none.dtypes == out.dtypes
    assert lexical.search(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA), items).count() == 0
