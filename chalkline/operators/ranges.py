"""Cutting hot groups into ranges of their own order.

Row-level windows need groups that a task can hold. Where the rows of a group
(a session, or a session's time bucket) are a noticeable share of the whole
table, the group is cut at places taken from a hashed sample of its own rows,
so a burst inside one second splits like any other stretch. Everything is one
plan: the counts and the sample are narrow aggregates, and the cuts are
broadcast: at most ``SHARE`` groups can be hot, each with about ``PIECES`` cuts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot when it has over HOT_ROWS rows and more than one in SHARE of all rows.
HOT_ROWS, SHARE = 100_000, 1024
#: Ranges of about this many that a hot group is cut into.
PIECES = 64


def cut_hot_groups(df: DataFrame, group: list[str], order: list[str], out: str, hot_rows: int = HOT_ROWS,
                   pieces: int = PIECES) -> DataFrame:
    """``df`` with ``out``: 0 for rows of ordinary groups, else the number of the row's range in its group.

    Ranges follow ``order``: a smaller range number means an earlier row. Rows equal in ``order`` share a range.
    """
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    share = (F.col("_rows") > hot_rows) & (F.col("_rows") * SHARE > counts.select(F.sum("_rows")).scalar())
    hot = counts.filter(share)
    key = F.struct(*order)
    rows = df.select(*group, key.alias("_at")).join(F.broadcast(hot), group)
    picked = rows.filter(F.pmod(F.xxhash64("_at"), F.greatest(F.lit(1), F.floor(F.col("_rows") / pieces))) == 0)
    cuts = picked.groupBy(*group).agg(F.sort_array(F.collect_set("_at")).alias("_cuts"))
    before = F.size(F.filter("_cuts", lambda c: c <= key))
    return (df.join(F.broadcast(cuts), group, "left")
            .withColumn(out, F.when(F.col("_cuts").isNull(), 0).otherwise(before)).drop("_cuts"))
