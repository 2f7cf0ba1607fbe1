"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each distinct vector, scaled to length one, is taken relative to the centroid
and rotated by a seeded random orthogonal matrix; the signs are its code. With
the residual's length, its inner product with the centroid and the cosine
between residual and code, an inner product with any query is estimated from
the bits alone, with an error bound. Queries meet all code blocks twice: first
the best estimates of each block are compared exactly, which gives a floor for
each query's k-th best similarity; then every vector whose upper bound reaches
the floor is compared on its original, and a block's k+1 best go on. Their
final scores are computed on the original vectors, in double precision.

Code blocks lie in parts, and a query block is copied once for each part. The
copies meet the parts in a merge join that is asked for by name: a plan's
estimate does not see how often a block is copied, so Spark would broadcast
gigabytes of copies through the driver.

Equal vectors are searched once: their group is represented by its smallest
vec_id and carries the k+1 smallest, all that a result can name, so a group of
copies of any size costs as much as one vector.

Defined results: vectors that are null, zero, or hold null, NaN or infinite
components take no part, neither do null vec_ids; all others do, however
large or small (a power of two is taken out before squaring). A vec_id that occurs again
counts once, with the smallest of its vectors in array order. Ties go to the
smaller vec_id. Vectors of different lengths are never neighbours. With fewer
candidates than k all are returned; an empty table, or one without queries,
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from chalkline.llm.common import materialize

SEED = 7
#: Standard errors in the bounds; the paper's 1.9 already finds nearly all neighbours.
EPSILON = 3.0
#: Vectors of a code block, queries of a query block.
CODE_ROWS, QUERY_ROWS = 4096, 512
#: Best estimates of a block that are compared for each neighbour wanted, to find the floor.
TRIED = 4
#: So many parts have one code block each at least; above, a part has up to so many blocks.
PARTS, PART_BLOCKS = 64, 16
#: Share of a block's comparisons from which all of them are made, by a matrix product.
DENSE = 1 / 32
#: What rounding may differ between two ways to compute a cosine.
ROUNDING = 1e-9

_BLOCK = "dim int, block int, vids binary, codes binary, scalars binary, vectors binary"
_QUERIES = "dim int, qblock int, qids binary, queries binary, floors binary"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is drawn."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one."""
    x = np.asarray(x, dtype=np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), dtype=kind).reshape(-1, dim)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and (length, inner product with the centre, cosine to the code) of unit vectors."""
    r = x - centre
    length = np.sqrt((r * r).sum(1))
    turned = (r / np.where(length > 0, length, 1)[:, None]) @ turn.T
    cosine = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(turned > 0, axis=1), np.stack([length, r @ centre, np.where(length > 0, cosine, 1)], 1).astype(np.float32)


def _encode_block(key: tuple, table: pa.Table, centres: dict[int, list[float]], seed: int, kind: str) -> pa.Table:
    dim = key[0].as_py()
    vectors = _matrix(table["embedding"], dim, kind)
    codes, scalars = encode(units(vectors), np.array(centres[dim]), rotation(dim, seed))
    vids = np.asarray(table["vid"], dtype=np.int64)
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
                     "vids": pa.array([vids.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary()),
                     "scalars": pa.array([scalars.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})


def _query_block(key: tuple, table: pa.Table, kind: str) -> pa.Table:
    dim = key[0].as_py()
    return pa.table({"dim": pa.array([dim], pa.int32()), "qblock": pa.array([key[1].as_py()], pa.int32()),
                     "qids": pa.array([np.asarray(table["vid"], dtype=np.int64).tobytes()], pa.binary()),
                     "queries": pa.array([_matrix(table["embedding"], dim, kind).tobytes()], pa.binary()),
                     "floors": pa.array([np.asarray(table["floor"], dtype=np.float64).tobytes()], pa.binary())})


def code_side(codes: np.ndarray, scalars: np.ndarray, dim: int, epsilon: float) -> np.ndarray:
    """Of every code the row that, multiplied with ``query_side``, gives its estimate; the last column gives the error bound."""
    norm, with_centre, cosine = scalars.T
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    slack = norm * epsilon * np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine / np.sqrt(max(dim - 1, 1))
    return np.concatenate([signs * (norm / cosine / np.sqrt(dim))[:, None], with_centre[:, None], slack[:, None]], 1).astype(np.float32)


def query_side(queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rows for ``code_side``, and at last what every query has in common with the centre."""
    r = queries - centre
    length = np.sqrt((r * r).sum(1, keepdims=True))
    return np.concatenate([r @ turn.T, np.ones_like(length), length, (queries @ centre)[:, None]], 1).astype(np.float32)


def bounds(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray,
           epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosine of every query (rows) with every coded vector (columns), and the estimate's error bound."""
    return _bounds(query_side(queries, centre, turn), code_side(codes, scalars, len(centre), epsilon))


def _bounds(asked: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # a few float32 roundings on top, so that equal vectors stay inside their bounds
    return asked[:, :-2] @ coded[:, :-1].T + asked[:, -1:], asked[:, -2:-1] * coded[None, :, -1] + np.float32(1e-5)


def _upper(asked: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """Estimate and error bound together."""
    return asked[:, :-1] @ coded.T + (asked[:, -1:] + np.float32(1e-5))


def _k_best(r: np.ndarray, c: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its k best, with what rounding might put among them."""
    order = np.lexsort((-exact, r))
    r, c, exact = r[order], c[order], exact[order]
    first = np.searchsorted(r, r)
    last = np.minimum(first + k, np.searchsorted(r, r, "right")) - 1
    keep = exact >= exact[last] - ROUNDING
    return r[keep], c[keep], exact[keep]


def _meet(batches, centres: dict[int, list[float]], seed: int, epsilon: float, k: int, final: bool, kind: str):
    """For each pair of blocks the k best of each query, among its best estimates or (final) among all whose upper bound reaches its floor."""
    turns, held, part = {}, {}, None
    for batch in batches:
        data = {name: batch.column(name) for name in batch.schema.names}
        for n in range(batch.num_rows):
            dim, block = data["dim"][n].as_py(), data["block"][n].as_py()

            def array(name: str, kind: str | type) -> np.ndarray:
                return np.frombuffer(data[name][n].as_buffer(), kind)

            centre, turn = np.array(centres[dim]), turns.setdefault(dim, rotation(dim, seed))
            if part != (dim, data["part"][n].as_py()):       # the blocks of a part meet one query block after the other
                part, held = (dim, data["part"][n].as_py()), {}
            if block not in held:
                vids = array("vids", np.int64)
                held[block] = (vids.copy(), units(array("vectors", kind).reshape(len(vids), dim)),
                               code_side(array("codes", np.uint8).reshape(len(vids), -1), array("scalars", np.float32).reshape(-1, 3), dim, epsilon))
            vids, vectors, coded = held[block]
            qids, floors = array("qids", np.int64), array("floors", np.float64)
            queries = units(array("queries", kind).reshape(len(qids), dim))
            asked = query_side(queries, centre, turn)
            if final:
                reached = _upper(asked, coded) >= np.nextafter(floors.astype(np.float32), np.float32(-8))[:, None]
                r, c = np.nonzero(reached)
                if len(r) > DENSE * reached.size:
                    exact = (queries @ vectors.T)[r, c]
                else:
                    exact = np.einsum("ij,ij->i", queries[r], vectors[c])
                near = exact >= floors[r]                   # k reach the floor, whatever rounding does
                r, c, exact = r[near], c[near], exact[near]
            else:
                about, tried = _bounds(asked, coded)[0], min(TRIED * k, len(vids))
                c = np.argpartition(-about, tried - 1, axis=1)[:, :tried]
                r, exact = np.repeat(np.arange(len(qids)), tried), np.einsum("ij,ikj->ik", queries, vectors[c]).ravel()
                c = c.ravel()
            r, c, exact = _k_best(r, c, exact, k)
            yield pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(vids[c]), pa.array(exact)], names=["qid", "vid", "cosine"])


def usable(embedding: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    x = embedding.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & ~odd & F.exists(x, lambda v: v != 0)


def scale(embedding: str) -> Column:
    """A power of two near the largest component: dividing by it is exact and keeps squares inside a double."""
    largest = F.array_max(F.transform(embedding, lambda x: F.abs(x.cast("double"))))
    return F.pow(F.lit(2.0), F.floor(F.log2(largest)).cast("double"))


def dot(a: str, b: str, scale_a: str, scale_b: str) -> Column:
    """Inner product of two vectors, each divided by its scale."""
    products = F.zip_with(a, b, lambda x, y: (x.cast("double") / F.col(scale_a)) * (y.cast("double") / F.col(scale_b)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``vid, embedding, dim, ids``: one row per distinct usable vector, with its k+1 smallest vec_ids."""
    own = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
           .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
           .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return (own.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
            .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
            .select(F.col("ids")[0].alias("vid"), "embedding", F.size("embedding").alias("dim"), "ids"))


def _in_blocks(rows: DataFrame, per_block: int, name: str) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // per_block))
    return rows.withColumn(name, F.pmod(F.xxhash64("vid"), F.lit(n)).cast("int")), n


def search(vectors: DataFrame, is_query: Column, k: int = 5, epsilon: float = EPSILON, seed: int = SEED,
           code_rows: int = CODE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` (on vec_id) its k nearest other rows by cosine."""
    index = materialize(distinct_vectors(vectors, k))
    centres: dict[int, dict[int, float]] = {}
    means = (index.withColumn("scale", scale("embedding"))
             .withColumn("length", F.sqrt(dot("embedding", "embedding", "scale", "scale")))
             .select("dim", F.posexplode("embedding").alias("at", "x"), "scale", "length")
             .groupBy("dim", "at").agg(F.avg(F.col("x").cast("double") / F.col("scale") / F.col("length")).alias("mean")))
    for r in means.collect():                               # as many values as a vector has components
        centres.setdefault(r["dim"], {})[r["at"]] = r["mean"]
    middle = {d: [c[i] for i in range(d)] for d, c in centres.items()}

    kind = "f4" if index.schema["embedding"].dataType.elementType == FloatType() else "f8"
    coded, n_blocks = _in_blocks(index.select("vid", "embedding", "dim"), code_rows, "block")
    blocks = materialize(coded.groupBy("dim", "block").applyInArrow(
        lambda key, t: _encode_block(key, t, middle, seed, kind), _BLOCK))
    n_parts = min(n_blocks, max(PARTS, -(-n_blocks // PART_BLOCKS)))
    parts = blocks.withColumn("part", F.pmod("block", F.lit(n_parts)))

    # queries of equal vectors are searched once; a vec_id's own vector is found again by its value
    asked = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
             .filter(F.col("vec_id").isNotNull() & is_query & usable(F.col("embedding")))
             .groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding")))
    queries = materialize(asked.join(index.select("vid", "embedding"), "embedding").select("query_id", "vid"))
    searched = index.join(queries.select("vid").distinct(), "vid", "left_semi").select("vid", "embedding", "dim")
    searched = materialize(searched)

    def meet(floors: DataFrame | None) -> DataFrame:
        rows, _ = _in_blocks(searched, query_rows, "qblock")
        rows = rows.withColumn("floor", F.lit(0.0)) if floors is None else rows.join(floors, "vid")
        q = rows.groupBy("dim", "qblock").applyInArrow(lambda key, t: _query_block(key, t, kind), _QUERIES)
        copies = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
        met = copies.hint("merge").join(parts.hint("merge"), ["dim", "part"])
        return met.mapInArrow(partial(_meet, centres=middle, seed=seed, epsilon=epsilon, k=k + 1, final=floors is not None, kind=kind),
                              "qid long, vid long, cosine double")

    # k+1: the query's own vector is among the best
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine"), "vid"))
    best = meet(None).withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("qid")
    floors = best.agg(F.when(F.count(F.lit(1)) > k, F.min("cosine") - ROUNDING).otherwise(-4.0).alias("floor"))
    found = meet(materialize(floors.select(F.col("qid").alias("vid"), "floor")))

    # of each query's k+1 best over all blocks, and what rounding might put among them
    last = F.nth_value("cosine", k + 1).over(Window.partitionBy("qid").orderBy(F.desc("cosine")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    found = found.withColumn("last", last).filter(F.col("last").isNull() | (F.col("cosine") >= F.col("last") - ROUNDING))
    scored = (found.select("qid", "vid").join(index.select("vid", "ids", F.col("embedding").alias("b")), "vid")
              .join(searched.select(F.col("vid").alias("qid"), F.col("embedding").alias("a")), "qid")
              .withColumns({"sa": scale("a"), "sb": scale("b")})
              .select("qid", F.explode("ids").alias("vec_id"),
                      (dot("a", "b", "sa", "sb") / (F.sqrt(dot("a", "a", "sa", "sa")) * F.sqrt(dot("b", "b", "sb", "sb")))).alias("score")))
    nearest = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    short = scored.withColumn("rank", nearest).filter(F.col("rank") <= k + 1).drop("rank")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (queries.join(short, queries["vid"] == short["qid"]).filter("query_id <> vec_id")
            .withColumn("rank", again).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
