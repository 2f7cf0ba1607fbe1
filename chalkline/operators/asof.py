"""The document each question sees.

A question sees what its session has stored at that moment (a document and a
question of the same event: the document comes first). There are two ways to
store: a document that replaces whatever there is, and one that is kept only
where the session has none yet (``if_none``; a follow-up reads its upload
only then). Both are transitions of the session's state, and so is any run of
them: the run's last replacing document if there is one, else its first
``if_none`` document, which counts only where nothing was stored before.

So the state after any number of runs is found from two values per run, without
a range join and without a window over the rows of a session:

1. rows are tagged with a time bucket, and a hot bucket is cut into ranges;
   the two values of every (session, bucket, range) are aggregates;
2. the state before each of them is a running "last" and "first" over that
   small aggregate;
3. inside one, rows are ordered and take the values of the run so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.ranges import HOT_ROWS, cut_hot_groups

DEFAULT_BUCKET_SECONDS = 3600


def state_after(replacing: Column, before: Column, if_none: Column) -> Column:
    """The state after a run: its last replacing document, what was stored before, or its first ``if_none`` document."""
    return F.coalesce(replacing, before, if_none)


def run_of(order: list[str]) -> tuple[Column, Column]:
    """A run's last replacing and its first ``if_none`` document (``_doc``, ``_if_none``), as aggregates."""
    at = F.struct(*order)
    some = F.col("_doc").isNotNull()
    return (F.max_by("_doc", F.when(some & ~F.col("_if_none"), at)), F.min_by("_doc", F.when(some & F.col("_if_none"), at)))


def session_events(questions: DataFrame, documents: DataFrame, session: str, ts: str, tiebreak: str, doc_cols) -> DataFrame:
    """Both sides in one frame: ``_kind`` 0 with ``_doc`` and ``_if_none``, 1 for questions with all their columns."""
    if_none = F.coalesce(F.col("if_none"), F.lit(False)) if "if_none" in documents.columns else F.lit(False)
    docs = documents.select(session, ts, tiebreak, F.struct(*doc_cols).alias("_doc"), if_none.alias("_if_none")).withColumn("_kind", F.lit(0))
    none = F.lit(None).cast(docs.schema["_doc"].dataType)
    return (questions.withColumns({"_kind": F.lit(1), "_doc": none, "_if_none": F.lit(False)})
            .unionByName(docs, allowMissingColumns=True))


def stored_after(documents: DataFrame, session: str = "session_id", ts: str = "ts", tiebreak: str = "event_id",
                 doc_cols=("doc_event_id",)) -> DataFrame:
    """``session, _last, _first``: each session's run of all its ``documents``."""
    events = session_events(documents.select(session, ts, tiebreak).limit(0), documents, session, ts, tiebreak, doc_cols)
    last, first = run_of([ts, tiebreak])
    return events.groupBy(session).agg(last.alias("_last"), first.alias("_first"))


def current_document(questions: DataFrame, documents: DataFrame, session: str = "session_id",
                     ts: str = "ts", tiebreak: str = "event_id", doc_cols=("doc_event_id",),
                     bucket_seconds: int = DEFAULT_BUCKET_SECONDS, hot_rows: int = HOT_ROWS,
                     before: DataFrame | None = None) -> DataFrame:
    """Attach ``doc`` (a struct of ``doc_cols``, null when none) to every question.

    ``documents`` needs session, ts, tiebreak and ``doc_cols``, and may say
    ``if_none``. ``before`` (session, ``doc_cols``) is what sessions had stored
    before any of these rows."""
    bucket = F.floor(F.unix_seconds(F.col(ts)) / F.lit(bucket_seconds)).cast("long")
    events = session_events(questions, documents, session, ts, tiebreak, doc_cols).withColumn("_b", bucket)
    events = cut_hot_groups(events, [session, "_b"], [ts, tiebreak], "_cut", hot_rows)
    last, first = run_of([ts, tiebreak])
    runs = events.groupBy(session, "_b", "_cut").agg(last.alias("_last"), first.alias("_first"))
    earlier = Window.partitionBy(session).orderBy("_b", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(session, "_b", "_cut", F.last("_last", ignorenulls=True).over(earlier).alias("_last_before"),
                          F.first("_first", ignorenulls=True).over(earlier).alias("_first_before"))
    so_far = (Window.partitionBy(session, "_b", "_cut").orderBy(ts, tiebreak, "_kind")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    replacing = F.when(~F.col("_if_none"), F.col("_doc"))
    kept = F.when(F.col("_if_none"), F.col("_doc"))
    seen = (events.withColumns({"_last": F.last(replacing, ignorenulls=True).over(so_far),
                                "_first": F.first(kept, ignorenulls=True).over(so_far)}).filter(F.col("_kind") == 1))
    out = seen.join(carried, [session, "_b", "_cut"], "left")
    held = F.lit(None).cast(events.schema["_doc"].dataType)
    if before is not None:
        out = out.join(before.select(session, F.struct(*doc_cols).alias("_held")), session, "left")
        held = F.col("_held")
    doc = state_after(F.coalesce("_last", "_last_before"), held, F.coalesce("_first_before", "_first"))
    return out.withColumn("doc", doc).drop("_b", "_cut", "_kind", "_doc", "_if_none", "_last", "_first", "_last_before",
                                           "_first_before", "_held")
