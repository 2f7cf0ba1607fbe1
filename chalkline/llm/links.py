"""Fingerprint links and connected components, shared by the fingerprint operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import materialize

#: Fingerprints that share a segment value before their links are found through common centres instead.
DENSE = 512


def distance(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def signed(value: int) -> int:
    """A 64-bit pattern as Spark's long."""
    return value - (1 << 64) if value >> 63 else value


def segments(m: int) -> list[tuple[int, int]]:
    """(shift, width) of m segments that cover 64 bits."""
    edges = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` flipped bits out of ``width``."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _keyed(fps: DataFrame, fp: str, m: int, radius: int) -> DataFrame:
    """``fp, key``: the segment number and value, for each value in the ball around the fingerprint's own."""
    rows = None
    for i, (shift, width) in enumerate(segments(m)):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.lit(x).cast("long") for x in ball(width, radius)])
        one = fps.select(fp, value.alias("value")).select(fp, F.explode(F.transform(masks, lambda x: x)).alias("mask"), "value")
        one = one.select(F.col(fp), F.struct(F.lit(i).alias("seg"), F.col("value").bitwiseXOR(F.col("mask")).alias("v")).alias("key"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def hamming_links(fps: DataFrame, radius: int, m: int = 2) -> DataFrame:
    """``a, b``: links that join exactly the fingerprints at most ``radius`` bits apart into components.

    ``fps`` has distinct longs ``fp``. Multi-index hashing: of m segments one
    differs in at most radius // m bits, so the small ball around each segment
    value is looked up among the values present, and the complete distance of
    what it fetches is verified. Where more than DENSE fingerprints share a
    value, the verified pairs of such a group could grow with its square:
    there two fingerprints are linked through a common centre, which any two
    within the radius have, at half of it from both; each group around a
    centre is a star to its smallest member.
    """
    table = _keyed(fps, "fp", m, 0)
    counted = materialize(table.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))))
    probes = _keyed(fps, "fp", m, radius // m)
    sparse = counted.filter(F.col("n") <= DENSE).select(F.col("fp").alias("b"), "key")
    links = (probes.join(sparse, "key").filter((F.col("fp") < F.col("b")) & (distance("fp", "b") <= radius))
             .select(F.col("fp").alias("a"), "b").distinct())
    crowded = counted.filter(F.col("n") > DENSE).select("key").distinct()
    if radius % 2 == 0 and not crowded.isEmpty():
        near = probes.join(crowded, "key", "left_semi").select("fp").distinct()
        masks = F.array(*[F.lit(signed(x)) for x in ball(64, radius // 2)])
        around = near.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"))
        first = around.groupBy("centre").agg(F.min("fp").alias("a"))
        stars = around.join(first, "centre").filter("a <> fp").select("a", F.col("fp").alias("b")).distinct()
        links = links.unionByName(stars)
    elif radius % 2:
        dense = counted.filter(F.col("n") > DENSE).select(F.col("fp").alias("b"), "key")
        links = links.unionByName(probes.join(dense, "key")
                                  .filter((F.col("fp") < F.col("b")) & (distance("fp", "b") <= radius))
                                  .select(F.col("fp").alias("a"), "b").distinct())
    return links


def components(links: DataFrame) -> DataFrame:
    """``node, root``: each linked node and the smallest node it reaches (roots included).

    Alternating large and small stars: every round points nodes at the
    smallest neighbour known so far, and rounds grow with the logarithm of the
    longest chain. Links live in the shared checkpoint folder between rounds.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(lowest.withColumnRenamed("m", "v")).distinct())
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
