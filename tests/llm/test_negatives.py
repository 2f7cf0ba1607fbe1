import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import negatives
from tests.llm.conftest import with_clashes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, k=5, share=(4, 5)):
    good = {}
    for i, e, label in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()),
                              key=lambda r: (r[0], r[2], r[1])):
        good.setdefault(i, ([int(v) for v in np.floor(256 * np.array(e, dtype=np.float64))], label))
    out = []
    for a, (x, label) in good.items():
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), i, l) for i, (y, l) in good.items() if i != a and len(y) == len(x)]
        for s, p, _ in sorted(r for r in scores if r[2] == label)[:k]:
            window = sorted(r for r in scores if r[2] != label and share[0] * -s <= share[1] * -r[0] <= share[1] * -s)
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(window[:k])]
    return sorted(out)


def mine(spark, rows, every, **more):
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **more).collect())


SMALL = {"tile_rows": 40, "pivots": 4, "leaf_rows": 4, "query_rows": 6}


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 10))
    rows = [(i, (centres[i % 6] + 0.2 * rng.standard_normal(10)).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    want = brute(rows, 10)
    assert len(want) > 300
    assert mine(spark, rows, 10, **SMALL) == want


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(2)
    base = [rng.integers(-3, 4, 4).tolist() for _ in range(60)]                 # many equal scores
    rows = [(i, [float(v) for v in e], i % 3) for i, e in enumerate(base)]
    rows += [(100 + i, rows[10][1], rows[10][2]) for i in range(50)] + [(200 + i, rows[10][1], 2 - rows[10][2]) for i in range(30)]
    rows += [(300, None, 1), (310, [1.0, None, 0.0, 0.0], 1), (320, [float("nan")] * 4, 1), (330, [float("inf")] * 4, 0), (340, [0.0] * 4, 0),
             (350, rows[3][1], None), (None, rows[3][1], 0), (360, [], 1), (370, [1.0, 2.0], 1), (371, [1.0, 2.5], 1), (372, [1.0, 1.9], 0),
             (10, rows[10][1], rows[10][2]), (20, [3.0, 3.0, 3.0, 3.0], 2), (380, [-1.0, -1.0, -1.0, -1.0], 7), (390, [0.0] * 4, 1)]
    assert mine(spark, rows, 10, **SMALL) == brute(rows, 10)


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(5) * 1e5).tolist(), i % 2) for i in range(60)]       # products beyond 2^52
    assert mine(spark, rows, 10, **SMALL) == brute(rows, 10)
    with pytest.raises(ValueError):
        mine(spark, [(0, [1e12, 1.0], 0), (1, [1.0, 1.0], 0)], 10)


def test_few_and_none(spark):
    assert mine(spark, [(0, [1.0, 0.0], 0)], 10) == []
    assert mine(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.9, 0.0], 1)], 10) == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_covers_and_skips():
    """Every point lies within its nodes' radii and bounds, is held once, and a clustered tile is not searched whole."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.floor(256 * (c + 0.05 * rng.standard_normal((100, 8)))) for c in rng.standard_normal((12, 8))]).astype(np.int64)
    n, label = len(x), rng.integers(0, 3, len(x))
    top = float(np.sqrt((x * x).sum(1).max()))
    tree = negatives.Tree(negatives.build_tree(x, np.arange(n), np.arange(n), label, top, 8))
    assert sorted(tree.order.tolist()) == list(range(n))
    queries = np.concatenate([x[:50], rng.integers(-300, 300, (20, 8))])
    scores = queries @ x.T
    norm = np.sqrt((queries.astype(float) ** 2).sum(1))

    def below(node):
        if tree.last[node] > tree.first[node]:
            return np.concatenate([below(c) for c in range(tree.first[node], tree.last[node])])
        return tree.order[tree.start[node]:tree.stop[node]]

    for node in range(len(tree.point)):
        members = below(node)
        low, high = tree.bounds(scores[:, [tree.point[node]]], norm, np.array([node]))
        assert (scores[:, members] >= low).all() and (scores[:, members] <= high).all()
    block = negatives.Block(np.arange(50), label[:50], np.full(50, negatives.LEAST), np.full(50, negatives.MOST), x[:50])
    q, p, s, seen = negatives.descend(tree, block, 5, True)
    for i in range(50):
        own = np.flatnonzero(label == label[i])
        want = own[np.lexsort((own, -scores[i, own]))][:5]
        assert p[q == i].tolist() == want.tolist() and s[q == i].tolist() == scores[i, want].tolist()
    assert seen["verified"] < 0.6 * seen["all"]


def test_windows_of_a_vector_share_its_products():
    """Five windows of each vector cost no more products than one, also where points without clusters leave little to skip."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((700, 24)) / 5).astype(np.int64)
    label, vid = rng.integers(0, 3, 700), rng.permutation(700)
    tree = negatives.Tree(negatives.build_tree(x, np.arange(700), vid, label, float(np.sqrt((x * x).sum(1).max()))))
    asked = np.repeat(np.arange(40), 5)
    scores = x[:40] @ x.T
    high = np.sort(np.where(label[:40, None] == label, scores, negatives.LEAST), 1)[:, -6:-1][:, ::-1].ravel()
    low = (4 * high + 4) // 5
    block = negatives.Block.unpack(negatives.Block(np.arange(200), label[asked], low, high, x[asked]).pack())
    q, p, s, seen = negatives.descend(tree, block, 5, False)
    for i, a in enumerate(asked):
        good = np.flatnonzero((label != label[a]) & (scores[a] >= low[i]) & (scores[a] <= high[i]))
        want = good[np.lexsort((vid[good], -scores[a, good]))][:5]
        assert p[q == i].tolist() == want.tolist() and s[q == i].tolist() == scores[a, want].tolist()
    assert seen["verified"] <= 40 * 700


@pytest.mark.parametrize("most", [5, 40_000, 1 << 40])
def test_integers_of_any_width_are_kept(most):
    x = np.array([[most, -3], [-most, 0], [1, 2]])
    tree = negatives.Tree(negatives.build_tree(x, np.arange(3), np.arange(3), np.zeros(3, int), 2.0 * most))
    block = negatives.Block.unpack(negatives.Block([7, 8, 9], [0, 0, 1], [1, 2, 3], [4, 5, 6], x[[0, 0, 0]]).pack())
    assert tree.x.tolist() == x.tolist() and block.x.tolist() == [x[0].tolist()] * 2
    assert block.of.tolist() == [0, 0, 1] and block.label.tolist() == [0, 1] and block.width.tolist() == [2, 1]
    assert block.qid.tolist() == [7, 8, 9] and block.low.tolist() == [1, 2, 3] and block.high.tolist() == [4, 5, 6]


def test_copies_of_blocks_are_not_broadcast(spark, monkeypatch):
    """They look as small as one copy to the planner, which would send all copies through the driver."""
    monkeypatch.setattr(negatives, "PARTS", 3)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist(), i % 3) for i in range(400)]
    found = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **SMALL | {"tile_rows": 20})
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [at#" in plan and "Join [tile#" not in plan
