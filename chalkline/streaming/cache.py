"""ST2: the response cache over a stream of routed requests.

Each micro-batch (``foreachBatch``) is resolved against the index as of the
previous batch (J2), read for the batch's own keys only (see
:mod:`chalkline.streaming.state`); duplicate keys inside the batch resolve by
W3; the batch's new entries become its delta of the index.

All writes are named by the batch id and overwrite, so a retried batch
rewrites the same directories and the result is the same.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.operators.cache import cache_replay
from chalkline.streaming.state import COMPACT_EVERY, KeyedState, MissingDelta

__all__ = ["COMPACT_EVERY", "MissingDelta", "index_state", "process_batch", "stream_cache"]


def index_state(index_dir: str, every: int = COMPACT_EVERY, **sizes: int) -> KeyedState:
    """The index: cache key to answer and audio path."""
    return KeyedState(index_dir, "key string", "text string, audio_path string", every, **sizes)


def process_batch(batch: DataFrame, batch_id: int, index_dir: str, out_dir: str,
                  every: int = COMPACT_EVERY, **sizes: int) -> None:
    """Resolve one micro-batch of requests (key, ts, event_id, response)."""
    state = index_state(index_dir, every, **sizes)
    # the batch is read for its keys and twice by the replay; what comes before it may be a stateful operator
    batch = batch.persist()
    cached = state.before(batch, batch_id).select("key", F.col("text").alias("_indexed"), F.lit(True).alias("_known"))
    replay = cache_replay(batch)     # hit within the batch, served text of the batch's first occurrence
    replay = (replay.join(cached, "key", "left")
              .withColumn("hit", F.col("hit") | F.col("_known").isNotNull())
              .withColumn("served_text", F.when(F.col("_known"), F.col("_indexed")).otherwise(F.col("served_text")))
              .drop("_indexed", "_known")).persist()
    try:
        served = replay.select("event_id", "key", "hit", "served_text")
        served.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))
        new_entries = replay.filter(~F.col("hit")).select("key", F.col("served_text").alias("text"),
                                                          F.lit(None).cast("string").alias("audio_path"))
        state.write(new_entries, batch_id)
    finally:
        replay.unpersist()
        batch.unpersist()


def stream_cache(requests: DataFrame, index_dir: str, out_dir: str, checkpoint: str, trigger_once: bool = True,
                 every: int = COMPACT_EVERY):
    """Start the ST2 query; returns the StreamingQuery."""
    writer = (requests.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, bid: process_batch(df, bid, index_dir, out_dir, every)))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
