"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.session import materialize

__all__ = ["EMBEDDED", "fresh", "materialize", "prefix_sums", "tokenizer_file", "unsigned_crc32"]

#: Arrow rows per batch are bounded by bytes as well as by count, so very long texts stay in small batches.
EMBEDDED = "__cl_"


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet (inputs may carry any extra columns)."""
    taken = {c.lower() for c in df.columns}
    name = EMBEDDED + name
    while name.lower() in taken:
        name += "_"
    return name


def unsigned_crc32(data: Column) -> Column:
    """CRC-32 of a string's UTF-8 bytes or of a binary column, as a non-negative long."""
    return F.crc32(data.cast("binary"))


def prefix_sums(totals: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` in the order of ``key``.

    Meant for partition totals: one row for each partition of a job, so a
    few hundred thousand short rows at the very most, whatever the data.
    """
    from pyspark.sql import Window
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias(out))
