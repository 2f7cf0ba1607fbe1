"""Response cache operators.

Cache keys are skewed by nature: every greeting for one subject, chapter
and source shares a key. Nothing here windows over a key; the first
occurrence and the latest version are per-key aggregates (partial
aggregation before the shuffle, one row per key per task after it), and
the join back to the request rows is an equi-join that adaptive execution
can split when one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY_COLUMNS = ["key", "text", "audio_path", "meta", "version"]


def cache_lookup(requests: DataFrame, responses: DataFrame, key: str = "key") -> DataFrame:
    """Every request with ``hit`` and the cached text/audio when present."""
    idx = responses.select(F.col("key").alias(key), F.col("text").alias("cached_text"),
                           F.col("audio_path").alias("cached_audio"), F.lit(True).alias("_present"))
    return (requests.join(idx, key, "left")
            .withColumn("hit", F.coalesce(F.col("_present"), F.lit(False))).drop("_present"))


def cache_misses(requests: DataFrame, responses: DataFrame, key: str = "key") -> DataFrame:
    """Requests that need a new answer (anti-join)."""
    return requests.join(responses.select(F.col("key").alias(key)), key, "left_anti")


def cache_hits(requests: DataFrame, responses: DataFrame, key: str = "key") -> DataFrame:
    """Requests answered from the cache (semi-join)."""
    return requests.join(responses.select(F.col("key").alias(key)), key, "left_semi")


def cache_replay(log: DataFrame, key: str = "key", ts: str = "ts", tiebreak: str = "event_id",
                 response: str = "response") -> DataFrame:
    """Run a request log through an initially empty cache.

    The first request of a key is a miss and its ``response`` is stored;
    every later request of that key is a hit served with the stored text.
    """
    order = F.struct(F.col(ts).alias("t"), F.col(tiebreak).alias("e"))
    first = log.groupBy(key).agg(F.min_by(F.struct(F.col(tiebreak).alias("first_event"),
                                                   F.col(response).alias("served")), order).alias("_f"))
    return (log.join(first, key)
            .withColumn("hit", F.col(tiebreak) != F.col("_f.first_event"))
            .withColumn("served_text", F.col("_f.served"))
            .drop("_f"))


def upsert_responses(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert or replace by key; the highest version wins, and an update
    wins a tie with the current entry. Applying the same updates twice
    changes nothing."""
    both = (current.select(*ENTRY_COLUMNS).withColumn("_rank", F.lit(0))
            .unionByName(updates.select(*ENTRY_COLUMNS).withColumn("_rank", F.lit(1))))
    best = both.groupBy("key").agg(F.max_by(F.struct(*[c for c in ENTRY_COLUMNS if c != "key"]),
                                            F.struct("version", "_rank")).alias("_e"))
    return best.select("key", *[F.col("_e." + c).alias(c) for c in ENTRY_COLUMNS if c != "key"])


def latest_entries(entries: DataFrame) -> DataFrame:
    """The index state of an entry log: the highest version of every key."""
    best = entries.groupBy("key").agg(F.max_by(F.struct(*[c for c in ENTRY_COLUMNS if c != "key"]),
                                               F.col("version")).alias("_e"))
    return best.select("key", *[F.col("_e." + c).alias(c) for c in ENTRY_COLUMNS if c != "key"])
