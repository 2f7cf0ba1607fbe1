"""Streaming session operators (ST1, ST3).

Each micro-batch is one batch job of the batch operators, W1 and J3, started
from what the sessions had before: a count of turns, or the stored document.
That state is keyed by session (:mod:`chalkline.streaming.state`) and read for
the batch's sessions only. No session's rows meet in one task or in Python: a
session with all rows of a trigger is spread as in batch.

Within a micro-batch rows are ordered by (ts, event_id); across micro-batches
the arrival order is the session order, as in an interactive session. State has
no timeout: like the reference, a session's document never expires. Outputs
are written to ``batch=<id>`` with overwrite, so a retried batch rewrites them.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.functions.keys import cache_key
from chalkline.functions.questions import cache_query, chapter_int, coerce_path, route_intent
from chalkline.operators.asof import current_document, state_after, stored_after
from chalkline.operators.sessions import number_turns
from chalkline.streaming.state import COMPACT_EVERY, KeyedState

CARRIED = ["subject", "chapter", "content_source", "message", "file_path"]


def turn_state(state_dir: str, every: int = COMPACT_EVERY) -> KeyedState:
    return KeyedState(state_dir, "session_id long", "turns long", every)


def document_state(state_dir: str, every: int = COMPACT_EVERY) -> KeyedState:
    return KeyedState(state_dir, "session_id long", "doc_event_id long, doc_path string", every)


def number_batch(batch: DataFrame, batch_id: int, state: KeyedState) -> DataFrame:
    """ST1 state: the position of every request of a micro-batch in its session. ``batch`` is read several times."""
    if "file_path" not in batch.columns:
        batch = batch.withColumn(
            "file_path", coerce_path(F.col("file")) if "file" in batch.columns else F.lit(None).cast("string"))
    rows = batch.select("session_id", "ts", "event_id", *CARRIED)
    seen = state.before(rows, batch_id).select("session_id", "turns")
    counts = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).join(seen, "session_id", "left")
    state.write(counts.select("session_id", (F.coalesce("turns", F.lit(0)) + F.col("_n")).alias("turns")), batch_id)
    numbered = number_turns(rows).join(seen, "session_id", "left")
    return numbered.withColumn("turn", (F.col("turn") + F.coalesce("turns", F.lit(0))).cast("int")).drop("turns")


def route_batch(batch: DataFrame, batch_id: int, state: KeyedState, upload_hashes: DataFrame | None = None) -> DataFrame:
    """ST1: W1 + P9 over a micro-batch; equals the batch routing when each session's requests arrive in order.

    With ``upload_hashes`` (a table of file_path, document_hash) the requests get their cache key (T14), so they can
    feed the streaming cache (ST2)."""
    r = number_batch(batch, batch_id, state)
    r = (r.withColumn("intent", route_intent(F.col("turn") == 1, F.col("message"), F.col("content_source")))
         .withColumn("chapter_no", chapter_int(F.col("chapter")))
         .withColumn("cache_query", cache_query(F.col("intent"), F.col("message"))))
    if upload_hashes is None:
        return r
    r = r.join(upload_hashes.select("file_path", "document_hash"), "file_path", "left")
    return r.withColumn("key", cache_key(F.col("intent"), F.col("subject"), F.col("chapter_no"),
                                         F.col("content_source"), F.col("cache_query"), F.col("document_hash")))


def document_batch(events: DataFrame, batch_id: int, state: KeyedState) -> DataFrame:
    """ST3: J3 over a micro-batch: ``session_id, event_id, doc_event_id, doc_path`` of its questions.

    ``events`` holds both sides: questions with ``kind`` 1 and processed documents with ``kind`` 0 (with doc_event_id,
    doc_path and, where they are stored only if the session has none, ``if_none``)."""
    columns = ("doc_event_id", "doc_path")
    if_none = F.coalesce(F.col("if_none"), F.lit(False)) if "if_none" in events.columns else F.lit(False)
    documents = events.filter("kind = 0").select("session_id", "ts", "event_id", *columns, if_none.alias("if_none"))
    questions = events.filter("kind = 1").select("session_id", "ts", "event_id")
    held = state.before(events, batch_id).select("session_id", *columns)
    runs = stored_after(documents, doc_cols=columns).join(
        held.select("session_id", F.struct(*columns).alias("_held")), "session_id", "left")
    after = state_after(F.col("_last"), F.col("_held"), F.col("_first"))
    state.write(runs.select("session_id", after.alias("d")).select("session_id", "d.*"), batch_id)
    out = current_document(questions, documents, doc_cols=columns, before=held)
    return out.select("session_id", "event_id", "doc.*")


def stream_batches(rows: DataFrame, step: Callable[[DataFrame, int], DataFrame], out_dir: str, checkpoint: str):
    """Start a query that writes ``step(micro-batch, batch_id)`` to ``out_dir/batch=<id>``; returns the StreamingQuery."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            step(batch, batch_id).write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))
        finally:
            batch.unpersist()

    return (rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
            .trigger(availableNow=True).start())


def stream_route_intent(requests: DataFrame, state_dir: str, out_dir: str, checkpoint: str,
                        upload_hashes: DataFrame | None = None, every: int = COMPACT_EVERY):
    """Start the ST1 query over a stream of requests."""
    state = turn_state(state_dir, every)
    return stream_batches(requests, lambda b, i: route_batch(b, i, state, upload_hashes), out_dir, checkpoint)


def stream_current_document(events: DataFrame, state_dir: str, out_dir: str, checkpoint: str, every: int = COMPACT_EVERY):
    """Start the ST3 query over a stream of documents and questions."""
    state = document_state(state_dir, every)
    return stream_batches(events, lambda b, i: document_batch(b, i, state), out_dir, checkpoint)
