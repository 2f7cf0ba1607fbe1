"""Hard-negative mining by a cover tree over norm-augmented candidates.

Components become integers (floor of 256 x), so inner products are exact. One
more component brings every candidate to the largest norm there is; on that
sphere a node's covering radius bounds the angle between its point and all
points below it, hence their inner products with any query, from above and
below. Rows near the same pivot (a bounded sample) share a tile of at most some
``TILE_ROWS`` rows, and each tile has a cover tree: the points of a level lie
further apart than its radius, and a node keeps the true covering radius of
what it holds. The descent is best-first, for a block of queries at a time: the
node of the highest bound is opened, queries whose floor or window lies outside
its bounds leave it, and the points reached are verified by their exact inner
product. A query first visits its own tile, which gives it a floor (the k-th
best score so far), then all others. Queries of one vector and label (an
anchor's windows) lie in one block and share their products and bounds.

Tiles lie in parts, and a block is copied once for each part. The copies meet
the parts in a merge join that is asked for by name: a plan's estimate does not
see how often a block is copied, so Spark would broadcast all copies.

Mining asks twice: for the best rows of the anchor's own label, then, for each
positive's score, for the best rows of other labels inside the window
``share`` * score <= negative score <= score.

Rows of equal vector and label form one class, which carries as many of its
smallest vec_ids as a result can name; a group of copies of any size is
searched once.

Defined results: rows whose vec_id, label or vector is null, or whose vector
holds a null or non-finite component, take no part; empty vectors neither. A
vec_id that occurs again counts once, with its smallest label and vector. Ties
go to the smaller vec_id. Vectors of different lengths have no inner product
and never meet. Zero vectors are candidates like any other. A positive of
negative score has no window, so no negatives; an anchor without positives has
no rows. Fewer than k rows in a window are all returned. Components so large
that inner products come near 64 bits raise ValueError. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import materialize

SCALE = 256
POSITIVES, NEGATIVES, SHARE = 5, 5, 0.8
TILE_ROWS, PIVOTS, LEAF_ROWS, QUERY_ROWS = 4096, 1024, 32, 512
#: Leaves of the highest bounds that are verified together.
LEAVES = 16
#: Scores that are compared with floors at once.
SCORES = 1 << 20
#: So many parts have one tile each at least; above, a part has up to so many tiles.
PARTS, PART_TILES = 64, 16
#: Ratio of the radii of two levels.
BASE = 1.5
LEAST, MOST = -(1 << 62), 1 << 62
#: Scores below this are exact in double precision.
EXACT = float(1 << 52)
#: And these in single precision.
EXACT_SINGLE = float(1 << 23)


# ---- the tree of a tile

def _largest(x: np.ndarray) -> float:
    return max(-float(x.min(initial=0)), float(x.max(initial=0)))


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the fewest of 2, 4 and 8 bytes that hold them all."""
    most = _largest(x)
    return np.ascontiguousarray(x, dtype="i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8")


class Tree:
    """Nodes of a cover tree over integer points, in the order in which they are made; a node's children follow each other."""

    PARTS = [("point", "i4"), ("radius", "f8"), ("first", "i4"), ("last", "i4"), ("start", "i4"), ("stop", "i4"), ("order", "i4"),
             ("cid", "i8"), ("vid", "i8"), ("label", "i8"), ("top", "f8")]

    def __init__(self, data: bytes):
        sizes = np.frombuffer(data, "i8", len(self.PARTS) + 1)
        at = sizes.nbytes
        for (name, kind), size in zip(self.PARTS, sizes):
            setattr(self, name, np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, at))
            at += int(size)
        self.x = np.frombuffer(data, f"i{sizes[-1]}", offset=at).reshape(len(self.cid), -1)

    def operands(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and points whose matrix product is exact: singles or doubles where every partial sum is, else longs."""
        most = _largest(queries) * _largest(self.x) * self.x.shape[1]
        kind = np.float32 if most < EXACT_SINGLE else np.float64 if most < EXACT else np.int64
        return queries.astype(kind), self.x.astype(kind)

    def bounds(self, score: np.ndarray, norm: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that anything below ``nodes`` (columns) can have with the queries (rows)."""
        reach = np.maximum(norm[:, None] * self.top[0], 1e-300)
        angle = np.arccos(np.clip(score / reach, -1, 1))
        cone = 2 * np.arcsin(np.minimum(1, self.radius[nodes] / max(2 * self.top[0], 1e-300)))
        slack = reach * 1e-7 + 1e-6
        return reach * np.cos(np.minimum(np.pi, angle + cone)) - slack, reach * np.cos(np.maximum(0, angle - cone)) + slack


def build_tree(x: np.ndarray, cid: np.ndarray, vid: np.ndarray, label: np.ndarray, top: float, leaf_rows: int = LEAF_ROWS) -> bytes:
    """The tree, in bytes. x: integer points; top: a norm that none exceeds."""
    points = x.astype(np.float64)
    square = (points * points).sum(1)
    lift = np.sqrt(np.maximum(top * top - square, 0))

    def distances(members: np.ndarray, centre: int) -> np.ndarray:
        """Of the lifted points; 0 for equal ones."""
        d = square[members] + square[centre] - 2 * (here @ points[centre]) + (lift[members] - lift[centre]) ** 2
        return np.sqrt(np.maximum(d, 0))

    here, everything = points, np.arange(len(x))
    root = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    nodes = [[root, float(distances(everything, root).max()), 0, 0, 0, 0]]
    held, order, at = {0: everything}, [], 0
    while at < len(nodes):
        members, (centre, radius, *_) = held.pop(at), nodes[at]
        if len(members) <= leaf_rows or radius == 0:
            nodes[at][4:] = [len(order), len(order) + len(members)]
            order.extend(members.tolist())
        else:
            nodes[at][2], near = len(nodes), radius / BASE
            here, left = points[members], np.ones(len(members), bool)
            while left.any():
                d = distances(members, centre)
                inside = left & ((d <= near) | (members == centre))
                nodes.append([centre, float(d[inside].max()), 0, 0, 0, 0])
                held[len(nodes) - 1] = members[inside]
                left &= ~inside
                centre = int(members[np.where(left, d, -1).argmax()])
            nodes[at][3] = len(nodes)
        at += 1
    parts = dict(zip(("point", "radius", "first", "last", "start", "stop"), zip(*nodes)))
    parts |= {"order": order, "cid": cid, "vid": vid, "label": label, "top": [top]}
    data, x = [np.ascontiguousarray(parts[name], dtype=kind).tobytes() for name, kind in Tree.PARTS], narrow(x)
    return np.array([*map(len, data), x.itemsize], "i8").tobytes() + b"".join(data) + x.tobytes()


class Block:
    """Queries: vectors, labels, and the window that a score must lie in. Neighbours of equal vector and label share one row of ``x``."""

    def __init__(self, qid, label, low, high, x, of=None):
        self.qid, label, self.low, self.high = (np.asarray(v, dtype=np.int64) for v in (qid, label, low, high))
        x = np.asarray(x)
        if of is None:
            x = x.astype(np.int64).reshape(len(self.qid), -1)
            new = np.ones(len(self.qid), bool)
            new[1:] = (x[1:] != x[:-1]).any(1) | (label[1:] != label[:-1])
            of, x = np.cumsum(new) - 1, x[new]
        self.of, self.x, self.query_label = np.asarray(of, dtype=np.int64), x, label
        #: of each row of x its first query, its number of queries and their label
        self.first = np.searchsorted(self.of, np.arange(len(x)))
        self.width = np.diff(np.append(self.first, len(self.of)))
        self.label = label[self.first]

    def pack(self) -> bytes:
        x = narrow(self.x)
        sizes = [len(self.qid), len(x), x.itemsize]
        return np.concatenate([sizes, self.qid, self.query_label, self.low, self.high, self.of]).astype("i8").tobytes() + x.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        n, m, size = np.frombuffer(data, "i8", 3).tolist()
        flat = np.frombuffer(data, "i8", 5 * n, 24).reshape(5, n)
        x = np.frombuffer(data, f"i{size}", offset=24 + flat.nbytes).reshape(m, -1)
        return cls(*flat[:4], x, flat[4])


def _first_k(q: np.ndarray, p: np.ndarray, s: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query's points the k best, by score and vid, and their places."""
    order = np.lexsort((vid[p], -s, q))
    q, p, s = q[order], p[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], p[keep], s[keep], place[keep]


def descend(tree: Tree, block: Block, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """Query numbers, point numbers and scores of each query's k best points in its window, of its own label or (not
    ``same``) of others; and how many points were verified and left out."""
    norm = np.sqrt((block.x.astype(np.float64) ** 2).sum(1))
    floor, best = block.low.copy(), np.full((len(block.qid), k), LEAST)
    queries, candidates = tree.operands(block.x)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen = {"verified": 0, "all": len(block.x) * len(tree.cid)}
    # of each vector the widest window that its queries leave; in the kind of the scores, in which all scores are exact
    lowest, highest = np.minimum.reduceat(floor, block.first), np.maximum.reduceat(block.high, block.first)
    kind = queries.dtype

    def verify(rows: np.ndarray, points: np.ndarray, score: np.ndarray) -> None:
        seen["verified"] += score.size
        step = max(1, SCORES // len(rows))
        for at in range(0, len(points), step):
            part = score[:, at:at + step]
            r, p = np.nonzero(part >= lowest[rows].astype(kind)[:, None])
            s, r, p = part[r, p].astype(np.int64), rows[r], points[at + p]
            good = (s <= highest[r]) & ((tree.label[p] == block.label[r]) == same)
            if good.any():
                keep(r[good], p[good], s[good])

    def keep(r: np.ndarray, p: np.ndarray, s: np.ndarray) -> None:
        width = block.width[r]
        nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        q, p, s = np.repeat(block.first[r], width) + nth, np.repeat(p, width), np.repeat(s, width)
        good = (s >= floor[q]) & (s <= block.high[q])
        q, p, s, place = _first_k(q[good], p[good], s[good], tree.vid, k)
        if not len(q):
            return
        found.append((q, p, s))
        own, at = np.unique(q, return_inverse=True)
        wide = np.full((len(own), k), LEAST)
        wide[at, place] = s
        best[own] = np.partition(np.concatenate([best[own], wide], 1), -k, axis=1)[:, -k:]
        floor[own] = np.maximum(floor[own], best[own].min(1))
        lowest[:] = np.minimum.reduceat(floor, block.first)

    def offer(rows: np.ndarray, nodes: np.ndarray) -> None:
        single = (tree.last[nodes] == tree.first[nodes]) & (tree.stop[nodes] - tree.start[nodes] == 1)
        if single.any():                                    # nothing below but the point itself
            points = tree.point[nodes[single]]
            verify(rows, points, queries[rows] @ candidates[points].T)
        nodes = nodes[~single]
        if not len(nodes):
            return
        low, high = tree.bounds((queries[rows] @ candidates[tree.point[nodes]].T).astype(np.float64), norm[rows], nodes)
        stays = (high >= lowest[rows, None]) & (low <= highest[rows, None])
        for j in np.flatnonzero(stays.any(0)):
            on = stays[:, j]
            heapq.heappush(heap, (-float(high[on, j].max()), int(nodes[j]), rows[on], high[on, j]))

    heap: list[tuple[float, int, np.ndarray, np.ndarray]] = []
    offer(np.arange(len(block.x)), np.zeros(1, np.int64))
    while heap:
        asked, points = np.zeros(len(block.x), bool), []
        while heap and len(points) < LEAVES:
            node = heap[0][1]
            inner = tree.last[node] > tree.first[node]
            if inner and points:
                break
            _, _, rows, high = heapq.heappop(heap)
            rows = rows[high >= lowest[rows]]
            if not len(rows):
                continue
            if inner:
                offer(rows, np.arange(tree.first[node], tree.last[node]))
            else:
                asked[rows] = True
                points.append(tree.order[tree.start[node]:tree.stop[node]])
        if points:
            rows, together = np.flatnonzero(asked), np.concatenate(points)
            verify(rows, together, queries[rows] @ candidates[together].T)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, seen
    q, p, s = (np.concatenate(v) for v in zip(*found))
    return *_first_k(q, p, s, tree.vid, k)[:3], seen


# ---- rows, classes and tiles

def usable_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, x``: one row per vec_id that takes part; x has integer components."""
    x = F.col("embedding").cast("array<double>")
    own = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("embedding"))
           .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)))
    own = own.filter(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    own = own.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    return own.select("vec_id", "row.label", F.transform("row.embedding", lambda v: F.floor(v * F.lit(float(SCALE)))).alias("x"))


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """``cid, vid, label, x, ids``: one row per (x, label) with its ``most`` smallest vec_ids, of which vid is the least."""
    rank = F.row_number().over(Window.partitionBy("x", "label").orderBy("vec_id"))
    grouped = (rows.withColumn("rank", rank).filter(F.col("rank") <= most)
               .groupBy("x", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    return grouped.select(F.col("ids")[0].alias("cid"), F.col("ids")[0].alias("vid"), "label", "x", F.size("x").alias("dim"), "ids")


def _nearest(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], tops: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """Number of the nearest pivot, among norm-augmented vectors."""
    for batch in batches:
        dims, values = np.asarray(batch.column(1)), batch.column(2)
        cells = np.zeros(len(dims), np.int32)
        for dim in np.unique(dims).tolist():
            p, top, own = pivots[dim], tops[dim], np.flatnonzero(dims == dim)
            x = np.asarray(values.take(pa.array(own)).flatten(), dtype=np.float64).reshape(-1, dim)
            x = np.concatenate([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]], 1)
            cells[own] = (x @ p.T).argmax(1)                # all of one norm: the nearest has the largest inner product
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells)], names=["of", "cell"])


def _tile(key: tuple, table: pa.Table, tops: dict[int, float], leaf_rows: int) -> pa.Table:
    dim = table["dim"][0].as_py()
    cid, vid, label = (np.asarray(table[c], dtype=np.int64) for c in ("cid", "vid", "label"))
    x = np.asarray(table["x"].combine_chunks().flatten(), dtype=np.int64).reshape(-1, dim)
    return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()),
                     "tree": pa.array([build_tree(x, cid, vid, label, tops[dim], leaf_rows)], pa.binary())})


def build_tiles(classes: DataFrame, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame, dict]:
    """(``tile, dim, tree``; ``of, home``: the tile of each class; for each dim its first tile and the one after its last)."""
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    stats = classes.groupBy("dim").agg(F.max(square).alias("top"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))).alias("most"),
                                       F.count(F.lit(1)).alias("n")).orderBy("dim").collect()   # a row per vector length
    if any(r["most"] ** 2 * r["dim"] >= float(MOST) / 8 for r in stats):
        raise ValueError("components are too large: inner products would not fit 64 bits")
    tops = {r["dim"]: float(np.sqrt(r["top"])) for r in stats}
    chosen = {}
    for r in stats:
        n = min(pivots, max(1, -(-2 * r["n"] // tile_rows)))
        sample = classes.filter(F.col("dim") == r["dim"]).select("x").orderBy(F.xxhash64("cid"), "cid").limit(n).collect()  # at most PIVOTS vectors
        x = np.array([s["x"] for s in sample], dtype=np.float64)
        chosen[r["dim"]] = np.concatenate([x, np.sqrt(np.maximum(tops[r["dim"]] ** 2 - (x * x).sum(1), 0))[:, None]], 1)
    cells = classes.select("cid", "dim", "x").mapInArrow(partial(_nearest, pivots=chosen, tops=tops), "of long, cell int")
    celled = materialize(classes.join(cells, F.col("cid") == F.col("of")).select("cid", "vid", "label", "x", "dim", "cell"))
    parts = celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("parts"))
    # a row per pivot: their running sum numbers the tiles, those of one dim next to each other
    first = F.coalesce(F.sum("parts").over(Window.orderBy("dim", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.withColumn("first", first))
    spans = {r["dim"]: (r["a"], r["b"]) for r in parts.groupBy("dim").agg(F.min("first").alias("a"), F.max(F.col("first") + F.col("parts")).alias("b")).collect()}
    numbered = celled.join(F.broadcast(parts), ["dim", "cell"]).withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("cid"), "parts")).cast("long"))
    tiles = materialize(numbered.groupBy("tile").applyInArrow(
        lambda key, t: _tile(key, t, tops, leaf_rows), "tile long, dim int, tree binary"))
    return tiles, numbered.select(F.col("cid").alias("of"), F.col("tile").alias("home")), spans


# ---- search

def _block_row(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by([("own", "ascending"), ("qid", "ascending")])     # a vector's queries follow each other
    dim = table["dim"][0].as_py()
    x = np.asarray(table["x"].combine_chunks().flatten(), dtype=np.int64)
    block = Block(*(np.asarray(table[c], dtype=np.int64) for c in ("qid", "label", "low", "high")), x)
    return pa.table({"dim": pa.array([dim], pa.int32()), "place": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([block.pack()], pa.binary())})


def _visit(batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, packed in zip(batch.column(0), batch.column(1)):
            tree, block = Tree(data.as_buffer()), Block.unpack(packed.as_buffer())
            q, p, s, _ = descend(tree, block, k, same)
            yield pa.RecordBatch.from_arrays([pa.array(block.qid[q]), pa.array(tree.cid[p]), pa.array(tree.vid[p]), pa.array(s)],
                                             names=["qid", "cid", "vid", "score"])


def best(rows: DataFrame, key: str | list[str], k: int, order: str = "vid") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(tiles: DataFrame, spans: dict, queries: DataFrame, k: int, same: bool, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``qid, cid, vid, score``: each query's (qid, dim, x, label, low, high, home, own) k best classes in its window.
    ``own``: the same for queries of one vector and label."""
    packed = "dim int, place long, block binary"
    columns = ["qid", "dim", "x", "label", "low", "high", "own"]

    def visit(blocks: DataFrame, tiles: DataFrame, at: str) -> DataFrame:
        # by name, see above; the tiles of a part are held while its blocks pass
        met = blocks.hint("merge").join(tiles.select("tree", F.col(at).alias("with")).hint("merge"), F.col("at") == F.col("with"))
        return met.select("tree", "block").mapInArrow(partial(_visit, k=k, same=same), "qid long, cid long, vid long, score long")

    # a tile is home to as many vectors as it has rows at most
    homes = queries.select(*columns, "home").groupBy("home").applyInArrow(_block_row, packed)
    first = materialize(best(visit(homes.withColumnRenamed("place", "at"), tiles, "tile"), "qid", k).drop("rank"))
    floors = first.groupBy(F.col("qid").alias("of")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    known = queries.join(floors, F.col("qid") == F.col("of"), "left").withColumn("low", F.greatest("low", F.coalesce("floor", F.lit(LEAST))))
    n_blocks = max(1, -(-queries.select("own").distinct().count() // query_rows))
    place = F.pmod(F.xxhash64("own"), F.lit(n_blocks)) + F.col("dim") * F.lit(n_blocks)
    blocks = known.select(*columns, place.cast("long").alias("place")).groupBy("place").applyInArrow(_block_row, packed)
    # the tiles of a dim follow each other, so those of a part nearly all have one length
    n_tiles = max(b for _, b in spans.values())
    per_part = max(1, min(PART_TILES, n_tiles // PARTS))
    parts = tiles.withColumn("part", F.floor(F.col("tile") / per_part) + F.col("dim") * F.lit(-(-n_tiles // per_part)))
    widths = {dim: [int(a) // per_part + dim * -(-n_tiles // per_part), int(b - 1) // per_part + dim * -(-n_tiles // per_part)] for dim, (a, b) in spans.items()}
    span = F.create_map(*[F.lit(v) for dim, ab in widths.items() for v in (dim, F.array(*[F.lit(x).cast("long") for x in ab]))])[F.col("dim")]
    everywhere = blocks.withColumn("at", F.explode(F.sequence(F.get(span, F.lit(0)), F.get(span, F.lit(1)))))
    # the second visit finds the home tile's rows again
    return best(visit(everywhere, parts, "part").unionByName(first).distinct(), "qid", k).drop("rank")


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         share: float = SHARE, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS, leaf_rows: int = LEAF_ROWS,
         query_rows: int = QUERY_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (``is_anchor`` on vec_id)
    and each of its best rows of the same label the best rows of other labels that score from ``share`` of the positive's
    score up to all of it."""
    rows = materialize(usable_rows(vectors, F.col("label") if label is None else label))
    most = max(positives + 1, negatives)
    classes = materialize(classes_of(rows, most))
    if classes.isEmpty():
        none = F.lit(None).cast("long")
        return rows.limit(0).select(F.col("vec_id").alias("anchor_id"), none.alias("positive_id"), F.lit(1).alias("rank"),
                                    none.alias("negative_id"), none.alias("positive_score"), none.alias("negative_score"))
    tiles, homes, spans = build_tiles(classes, tile_rows, pivots, leaf_rows)
    anchors = rows.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "x", "label")
    anchors = materialize(anchors.join(classes.select("x", "label", "cid"), ["x", "label"]).select("anchor_id", F.col("cid").alias("qid")))
    asked = classes.join(anchors.select("qid").distinct(), F.col("cid") == F.col("qid"), "left_semi").join(homes, F.col("cid") == F.col("of"))
    asked = materialize(asked.select(F.col("cid").alias("qid"), "dim", "x", "label", "home"))
    members = classes.select(F.col("cid").alias("class"), "ids")

    def expanded(found: DataFrame, k: int) -> DataFrame:
        each = found.join(members, F.col("cid") == F.col("class")).select("qid", "score", F.explode("ids").alias("vid"))
        return best(each, "qid", k)

    windows = asked.withColumns({"low": F.lit(LEAST).cast("long"), "high": F.lit(MOST).cast("long"), "own": F.col("qid")})
    near = materialize(expanded(search(tiles, spans, windows, positives + 1, True, query_rows), positives + 1).drop("rank"))
    mates = anchors.join(near, "qid").filter("anchor_id <> vid")
    mates = materialize(best(mates, "anchor_id", positives).select("anchor_id", F.col("qid").alias("aid"), F.col("vid").alias("positive_id"),
                                                                   F.col("score").alias("positive_score")))

    t = Fraction(str(share)).limit_denominator(1000)
    low = F.expr(f"(positive_score * {t.numerator}L + {t.denominator - 1}L) div {t.denominator}L")
    spots = mates.filter("positive_score >= 0").select("aid", F.col("positive_score").alias("high")).distinct()
    spots = materialize(spots.withColumn("wid", F.monotonically_increasing_id()))
    windows = spots.withColumn("positive_score", F.col("high")).withColumn("low", low).join(asked.withColumnRenamed("qid", "own"), F.col("aid") == F.col("own"))
    windows = materialize(windows.select(F.col("wid").alias("qid"), "dim", "x", "label", "low", "high", "home", "own"))
    hard = expanded(search(tiles, spans, windows, negatives, False, query_rows), negatives)
    hard = hard.select(F.col("qid").alias("wid"), "rank", F.col("vid").alias("negative_id"), F.col("score").alias("negative_score"))
    found = mates.join(spots.select("wid", F.col("aid").alias("of"), "high"), (F.col("aid") == F.col("of")) & (F.col("positive_score") == F.col("high")))
    return found.join(hard, "wid").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                                          "positive_score", "negative_score")
