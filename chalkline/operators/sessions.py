"""Session operators: turn numbering, routing, pairing, replay, transcripts.

Hot sessions. Any one session may hold a large share of all rows, so no
operator here runs a window over a whole session:

* turn numbers are a two-level prefix sum: rows are counted per
  (session, time bucket) with map-side partial aggregation, bucket
  offsets are a running sum over that small aggregate, and row numbers are
  taken inside each (session, bucket) only; a bucket that holds a large share
  of all rows is cut further, at places its own rows give;
* "first turn" is a per-session minimum (partial aggregation), not a window;
* pairing a message with its reply is an equi-join on the unique
  (session, turn) key, which cannot be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.textops import col_of, py_strip
from chalkline.operators.ranges import HOT_ROWS, cut_hot_groups

DEFAULT_BUCKET_SECONDS = 3600


def _bucket(ts: str, bucket_seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(bucket_seconds)).cast("long")


def number_turns(df: DataFrame, session: str = "session_id", ts: str = "ts", tiebreak: str = "event_id",
                 out: str = "turn", bucket_seconds: int = DEFAULT_BUCKET_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``out`` = 1-based position of each row in its session by (ts, tiebreak).

    Rows are numbered per (session, time bucket, range of a hot bucket) plus
    the counts of earlier ones, so a hot session is spread over its buckets
    and a burst inside one bucket over ranges of its own rows."""
    b, cut = "_bucket", "_cut"
    x = cut_hot_groups(df.withColumn(b, _bucket(ts, bucket_seconds)), [session, b], [ts, tiebreak], cut, hot_rows)
    counts = x.groupBy(session, b, cut).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(session).orderBy(b, cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(session, b, cut, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(session, b, cut).orderBy(F.col(ts), F.col(tiebreak))
    return (x.join(offsets, [session, b, cut])
            .withColumn(out, (F.col("_offset") + F.row_number().over(inner)).cast("int"))
            .drop(b, cut, "_offset"))


def mark_first(df: DataFrame, session: str = "session_id", ts: str = "ts", tiebreak: str = "event_id",
               out: str = "is_first") -> DataFrame:
    """``out`` = the row opens its session (history was empty)."""
    first = (df.groupBy(session)
             .agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tiebreak).alias("e"))).alias("_first")))
    return (df.join(first, session)
            .withColumn(out, (F.col(ts) == F.col("_first.t")) & (F.col(tiebreak) == F.col("_first.e")))
            .drop("_first"))


def pair_turns(conversations: DataFrame) -> DataFrame:
    """Each user message with the reply that follows it (null when the
    next row is not an assistant reply or there is none).

    Turns are list positions, so the reply of turn t is turn t + 1."""
    users = conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user"))
    nxt = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"),
                               F.col("role").alias("_next_role"), F.col("text").alias("_next_text"))
    return (users.join(nxt, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "user",
                    F.when(F.col("_next_role") == "assistant", F.col("_next_text")).alias("teacher")))


def display_message(message) -> Column:
    """What the history shows for a request: the message, or a session-start
    marker when it is empty."""
    m = col_of(message)
    return F.when(m.isNull() | (m == ""), F.lit(R.EMPTY_MESSAGE_DISPLAY)).otherwise(m)


def turn_label_index(label) -> Column:
    """J4 label parsing: ``Turn n`` to n; anything unparseable to null."""
    lab = col_of(label)
    return py_strip(F.replace(lab, F.lit(R.TURN_LABEL_HEAD), F.lit(""))).try_cast("int")


def replay_turn(turns: DataFrame, picks: DataFrame, session: str = "session_id") -> DataFrame:
    """The teacher text and audio of the picked turn; ('', null) when the
    label does not name an existing turn."""
    p = picks.withColumn("_idx", turn_label_index(F.col("label")))
    t = turns.select(F.col(session), F.col("turn").alias("_idx"), F.col("teacher").alias("_teacher"),
                     F.col("audio").alias("_audio"))
    return (p.join(t, [session, "_idx"], "left")
            .withColumn("replay_text", F.coalesce(F.col("_teacher"), F.lit("")))
            .withColumn("replay_audio", F.col("_audio"))
            .drop("_idx", "_teacher", "_audio"))


def quick_action_message(code) -> Column:
    """Quick-action code to its fixed message (null for an unknown code)."""
    m = F.create_map(*[x for pair in R.QUICK_ACTIONS for x in (F.lit(pair[0]), F.lit(pair[1]))])
    return F.try_element_at(m, col_of(code))


def expand_quick_action(actions: DataFrame, code: str = "action") -> tuple[DataFrame, DataFrame]:
    """(accepted rows with their message, rejected rows with an unknown code).

    The action table is a three-entry literal map, evaluated in the
    projection: no join and no shuffle."""
    x = actions.withColumn("message", quick_action_message(F.col(code)))
    return x.filter(F.col("message").isNotNull()), x.filter(F.col("message").isNull()).drop("message")


def transcript_block(turn, user, teacher) -> Column:
    """The three markdown lines of one turn, joined by the line separator."""
    return F.concat(F.lit(R.TRANSCRIPT_TURN_HEAD), col_of(turn).cast("string"), F.lit(R.TRANSCRIPT_SEPARATOR),
                    F.lit(R.TRANSCRIPT_USER_HEAD), F.coalesce(col_of(user), F.lit("")), F.lit(R.TRANSCRIPT_SEPARATOR),
                    F.lit(R.TRANSCRIPT_TEACHER_HEAD), F.coalesce(col_of(teacher), F.lit("")))


def transcript_lines(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """A2 without the final concatenation: one row per markdown line, in
    order (session, turn, line_no). Fully distributed."""
    lines = F.array(
        F.concat(F.lit(R.TRANSCRIPT_TURN_HEAD), F.col("turn").cast("string")),
        F.concat(F.lit(R.TRANSCRIPT_USER_HEAD), F.coalesce(F.col("user"), F.lit(""))),
        F.concat(F.lit(R.TRANSCRIPT_TEACHER_HEAD), F.coalesce(F.col("teacher"), F.lit(""))))
    return (turns.select(session, "turn", F.posexplode(lines).alias("pos", "line"))
            .select(session, "turn", (F.col("pos") + 1).alias("line_no"), "line"))


TRANSCRIPT_PAGE_TURNS = 100


def render_transcript(turns: DataFrame, session: str = "session_id",
                      page_turns: int = TRANSCRIPT_PAGE_TURNS) -> DataFrame:
    """A2: the markdown transcript of each session; every line (not every
    turn) is separated by a horizontal rule.

    Rendered in pages of at most ``page_turns`` turns, one row per
    (session, page): no session is gathered into one task whatever its
    length, and joining a session's pages in page order with the same
    separator gives its whole transcript."""
    blocks = turns.select(session, "turn", ((F.col("turn") - 1) / page_turns).cast("int").alias("page"),
                          transcript_block(F.col("turn"), F.col("user"), F.col("teacher")).alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "block")))
    return (blocks.groupBy(session, "page")
            .agg(F.count(F.lit(1)).alias("n_turns"),
                 F.array_join(F.transform(ordered, lambda s: s["block"]), R.TRANSCRIPT_SEPARATOR)
                 .alias("transcript")))


HISTORY_SCHEMA = "array<struct<user:string,teacher:string,audio:string>>"


def upgrade_history(history_json) -> Column:
    """A stored history (JSON) as ``array<struct<user,teacher,audio>>``.

    When the first element is a legacy ``[user, teacher]`` pair, every
    element is read as a pair and gets a null audio."""
    h = col_of(history_json)
    legacy = F.from_json(h, "array<array<string>>")
    upgraded = F.transform(legacy, lambda p: F.struct(F.get(p, 0).alias("user"), F.get(p, 1).alias("teacher"),
                                                      F.lit(None).cast("string").alias("audio")))
    return F.when(h.rlike(r"^\s*\[\s*\["), upgraded).otherwise(F.from_json(h, HISTORY_SCHEMA))
