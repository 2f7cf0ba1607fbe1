import numpy as np
from pyspark.sql import functions as F

from chalkline.llm import ann
from tests.llm.conftest import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    good = {i: np.array(e, dtype=np.float64) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all() and np.any(e)}
    out = []
    for q, a in good.items():
        if q % every == 0:
            near = sorted((-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i) for i, b in good.items() if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def search(spark, rows, every=50, k=5, **more):
    df = with_clashes(spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA))
    return sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % every == 0, k, **more).collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_recall_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = search(spark, rows, every=10, code_rows=64, query_rows=16), brute(rows, 10, 5)
    assert len(got) == len(want)
    hits = len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want})
    assert hits / len(want) >= 0.99


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, turn = x.mean(0), ann.rotation(48)
    codes, scalars = ann.encode(x, centre, turn)
    about, slack = ann.bounds(codes, scalars, x[:40], centre, turn, ann.EPSILON)
    assert codes.shape == (300, 6)
    assert (np.abs(about - x[:40] @ x.T) <= slack).mean() > 0.995


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(4)
    base = [rng.standard_normal(8).astype(np.float32).tolist() for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[3]) for i in range(40)] + [(i, base[3]) for i in (50, 60)]       # a group of copies, with queries in it
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("inf")] * 8),
             (None, base[5]), (205, []), (210, [1.0, 2.0]), (211, [2.0, 4.5]), (220, [-x for x in base[3]])]
    rows += [(7, base[7])]                                                                    # a repeated row
    unique = list(dict((i, e) for i, e in rows if i is not None).items())
    same(search(spark, rows, every=10, k=5, code_rows=16, query_rows=4), brute(unique, 10, 5))


def test_very_large_and_small(spark):
    rows = [(0, [1.0] * 4), (1, [1e200] * 4), (2, [1e-200] * 4), (3, [1e-310] * 4), (4, [1.7e308, 0.0, 0.0, 0.0]), (5, [-1e-200] * 4),
            (50, [3e-320, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(df, F.col("vec_id") % 50 == 0, 6).collect()}
    want = {(0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 0.5, (0, 50): 0.5, (0, 5): -1,
            (50, 4): 1, (50, 0): 0.5, (50, 1): 0.5, (50, 2): 0.5, (50, 3): 0.5, (50, 5): -0.5}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_few_and_none(spark):
    same(search(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0])]), [(0, 1, 1, 1 / np.sqrt(2))])
    assert search(spark, [(0, [1.0, 0.0])]) == []
    assert search(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.5])]) == []
    assert ann.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_copies_of_query_blocks_are_not_broadcast(spark):
    """They look as small as one copy to the planner, which would send all copies through the driver."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.standard_normal(16).tolist(), 0) for i in range(400)], SCHEMA)
    found = ann.search(df, F.col("vec_id") % 5 == 0, 5, code_rows=4, query_rows=8)
    assert found.count() == 80 * 5
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [dim#" in plan and "BroadcastHashJoin [dim#" not in plan


def test_parts_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "PARTS", 3)
    monkeypatch.setattr(ann, "PART_BLOCKS", 5)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(300)] + [(300 + i, rng.standard_normal(3).astype(np.float32).tolist()) for i in range(40)]
    same(search(spark, rows, every=10, k=5, code_rows=8, query_rows=4), brute(rows, 10, 5))
