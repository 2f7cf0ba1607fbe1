"""Sharding: a Feistel permutation over global row numbers, in DataFrame functions only.

Rows are numbered in the order of their key columns (a range shuffle, local
numbers, and the partitions' prefix sums). A mixed-radix Feistel network
permutes 0..a*b-1 where a*b is just over the row count; rows that land
outside walk on along their cycle until they are inside. The place gives
shard (place mod shards) and slot (place div shards), so both can be computed
for any row number without looking at another row, shard counts differ by one
at most, and slots have no gap.

Defined results: the order is by the key columns with nulls first; rows equal
in all key columns are interchangeable; an empty table gives no rows; very
long texts only enter through their sizes and checksums; all input columns
stay and the added columns must be new names, else ValueError.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import fresh, materialize, prefix_sums

ROUNDS = 6
SEED = 20_240_229
#: Cycle steps in one expression; rows still outside take further passes.
WALK = 16


def radices(n: int) -> tuple[int, int]:
    """a, b with a*b >= n and a*b - n < a, near the square root."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(place: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """One application of the permutation of 0..a*b-1 (see :func:`radices`).

    Even rounds add a hash of the right digit to the left one modulo a, odd
    rounds the reverse modulo b; the hash is Spark's xxhash64 of (digit, seed, round).
    """
    a, b = radices(n)
    left, right = F.floor(place / F.lit(b)).cast("long"), F.pmod(place, F.lit(b))
    for i in range(rounds):
        if i % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed).cast("long"), F.lit(i)), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed).cast("long"), F.lit(i)), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def number_rows(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds the global row number (0, 1, ...) in the order of ``keys``; no task sees more than a range partition."""
    mid, part = fresh(rows, "mid"), fresh(rows, "part")
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # stored once: local numbers and totals then come from the same partitions
    local = materialize(ordered.withColumn(mid, F.monotonically_increasing_id()))
    local = local.withColumn(part, F.shiftright(mid, 33))
    place = fresh(local, "place")
    places = prefix_sums(local.groupBy(part).agg(F.count(F.lit(1)).alias(mid)), part, mid, place)
    return (local.join(F.broadcast(places), part)           # one short row for each partition
            .withColumn(out, F.col(place) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)))
            .drop(mid, part, place))


def row_versions(rows: DataFrame, out: str) -> DataFrame:
    """Adds ``out``, which together with doc_id names one row: 0 where no other row has the doc_id, else (a doc_id that is
    null or repeated) 1 and on, in the order of doc_id, the text's hash and, for exact repeats, the place in the input."""
    again, text, place = (fresh(rows, c) for c in ("again", "hash", "input"))
    found = rows.groupBy(F.col("doc_id").cast("long").alias(again)).agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(found.filter(f"n > 1 or {again} is null").select(again))
    if repeated.isEmpty():
        return rows.withColumn(out, F.lit(0).cast("long"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(again))
    # the place must not change between the passes over it: these rows are stored, the others are read where they lie
    odd = materialize(rows.join(repeated, same, "left_semi").withColumns(
        {text: F.xxhash64("text"), place: F.monotonically_increasing_id()}))
    odd = number_rows(odd, ["doc_id", text, place], out).drop(text, place)
    return rows.join(repeated, same, "left_anti").withColumn(out, F.lit(0).cast("long")).unionByName(
        odd.withColumn(out, F.col(out) + 1))


def permute(numbers: DataFrame, column: str, n: int, seed: int = SEED, walk: int = WALK) -> DataFrame:
    """Replaces the row numbers in ``column`` by their permuted places in 0..n-1."""
    a, b = radices(n)
    outside = a * b - n                                     # no walk is longer than this
    steps = min(outside, walk)
    start = numbers.withColumn(column, feistel(F.col(column), n, seed))
    if not steps:
        return start

    def walked(df: DataFrame) -> DataFrame:
        return df.withColumn(column, F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), F.col(column),
            lambda at, _: F.when(at < n, at).otherwise(feistel(at, n, seed))))

    df, left = walked(start), outside - steps
    while left > 0 and not df.filter(F.col(column) >= n).isEmpty():
        df, left = walked(materialize(df)), left - steps
    return df


def assign_shards(rows: DataFrame, keys: list[str], shards: int, seed: int = SEED) -> DataFrame:
    """All columns of ``rows`` with ``shard`` (int) and ``slot`` (long): a reproducible shuffle into
    ``shards`` shards whose row counts are at most one apart."""
    if clash := {"shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"input already has columns {sorted(clash)}")
    place = fresh(rows, "row")
    numbered = number_rows(rows, keys, place)
    n = numbered.count()
    permuted = permute(numbered, place, n, seed)
    return (permuted.withColumn("shard", F.pmod(F.col(place), F.lit(shards)).cast("int"))
            .withColumn("slot", F.floor(F.col(place) / F.lit(shards)).cast("long")).drop(place))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder per shard, each in slot order inside its files."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
