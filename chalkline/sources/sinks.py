"""Append-only sinks (S8 audit records, S9 history), written exactly once.

What is appended is named by the job or micro-batch that appends it and
replaces whatever that name held, so a retried job leaves one copy. Readers see
only names whose job committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chalkline.sources.store import Store

HISTORY = "session_id long, turn int, user string, teacher string, audio string"


def _append(df: DataFrame, path: str, batch_id: int | str) -> None:
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def audit_sink(df: DataFrame, kind: str, path: str, batch_id: int | str) -> None:
    """Append off-topic questions (question, subject) or user details (details), by kind."""
    _append(df, f"{path.rstrip('/')}/kind={kind}", batch_id)


def history_sink(df: DataFrame, path: str, batch_id: int | str) -> None:
    """Append history rows (session_id, turn, user, teacher, audio)."""
    _append(df.select("session_id", "turn", "user", "teacher", "audio"), path, batch_id)


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed batches under ``path``, with ``batch``."""
    store = Store(spark, path)
    folders = [store.at(n) for n in store.names() if n.startswith("batch=") and store.complete(n)]
    if not folders:
        return spark.createDataFrame([], f"{schema}, batch string")
    return spark.read.schema(f"{schema}, batch string").option("basePath", store.root).parquet(*folders)
