"""Input tables derived from the driver parquet files.

Everything here is a projection or an explode of one driver table (plus
the upload-hash lookup), so the derived tables grow with the data and keep
each source text whole. Only the columns an operator needs are selected,
so the parquet scan reads nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions.questions import coerce_path
from chalkline.plans import salt as S
from chalkline.sources.tables import read_table


def pick(choices, idx: Column) -> Column:
    """``choices[idx]`` for a 0-based index column."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), idx.cast("int") + 1)


def salted(text: Column, ident: Column, phrases, sep: str = " ") -> Column:
    """Prepend ``phrases[ident % n]`` (and a separator) to the whole text."""
    return F.concat(pick(phrases, ident % len(phrases)), F.lit(sep), F.coalesce(text, F.lit("")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def content_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a content phrase in front (T4 / flagship input)."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", salted(F.col("text"), F.col("doc_id"), S.CONTENT_PHRASES).alias("text"))


def language_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents led by a script phrase repeated in proportion to the text
    (none, 1/16 or 1/8 of its length), so the T5 ratio lands on both sides
    of the threshold while the whole text is still counted."""
    d = documents(spark, sf_dir)
    phrase = pick(S.LANGUAGE_PHRASES, F.col("doc_id") % len(S.LANGUAGE_PHRASES))
    times = (F.length("text") / 16).cast("int") * ((F.col("doc_id") / 6).cast("long") % 3)
    lead = F.expr("repeat(concat(p, ' '), n)").alias("lead")
    return (d.select("doc_id", "text", phrase.alias("p"), times.cast("int").alias("n"))
            .select("doc_id", F.concat(lead, F.coalesce(F.col("text"), F.lit(""))).alias("text")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _ts_seconds(conv: Column, turn: Column) -> Column:
    return (F.lit(S.EPOCH_2024) + turn * S.TURN_SECONDS + (conv * S.SESSION_OFFSET_MULT) % S.TURN_SECONDS)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uploaded file per page: ``uploads/<page_id>/<name>`` holding the
    page's HTML bytes (the S2 shape: path, length, content)."""
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    name = pick(S.FILE_NAMES, F.col("page_id") % len(S.FILE_NAMES))
    content = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return p.select("page_id", F.concat(F.lit("uploads/"), F.col("page_id").cast("string"), F.lit("/"), name)
                    .alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log: one request per student turn, plus an empty
    session-start request for each system row.

    Columns follow the ``requests`` schema: session_id, ts, event_id,
    subject, chapter, content_source, file struct, message.
    """
    c = conversations(spark, sf_dir).filter(F.col("role").isin("user", "system"))
    conv, turn = F.col("conv_id"), F.col("turn")
    event_id = conv * S.EVENT_ID_MULT + turn
    fname = pick(S.FILE_NAMES, conv % len(S.FILE_NAMES))
    fpath = F.concat(F.lit("uploads/"), conv.cast("string"), F.lit("/"), fname)
    shape = conv % 4
    file = (F.when(shape == 1, F.struct(fpath.alias("path"), fpath.alias("name"), fname.alias("orig_name")))
            .when(shape == 2, F.struct(F.lit("").alias("path"), fpath.alias("name"), fname.alias("orig_name")))
            .when(shape == 3, F.struct(F.lit(None).cast("string").alias("path"), F.lit("").alias("name"),
                                       fname.alias("orig_name"))))
    message = F.when(F.col("role") == "system", F.lit("")).otherwise(
        salted(F.col("text"), event_id, S.QUESTION_PHRASES))
    return c.select(
        conv.alias("session_id"),
        F.timestamp_seconds(_ts_seconds(conv, turn)).alias("ts"),
        event_id.alias("event_id"),
        pick(S.SUBJECT_CHOICES, conv % 5).alias("subject"),
        pick(S.CHAPTER_CHOICES, conv % 14).alias("chapter"),
        pick(S.SOURCE_CHOICES, (conv / 5).cast("long") % 3).alias("content_source"),
        file.alias("file"),
        message.alias("message"),
        turn.alias("conv_turn"),
    )


def with_upload_hash(spark: SparkSession, sf_dir: str, reqs: DataFrame) -> DataFrame:
    """Requests with the SHA-256 of the uploaded file (T15), null when the
    path is missing or no such upload exists (the reference's unreadable
    file). Equi-join on path; only (path, hash) crosses the shuffle, and
    AQE broadcasts that side only when its measured size is small."""
    from chalkline.functions.keys import file_hash
    r = reqs.withColumn("file_path", coerce_path(F.col("file")))
    # only uploads that some request names are read and hashed: a semi-join on the distinct
    # requested paths (taken from a narrow scan of the request log) runs before the hashing
    named = (requests(spark, sf_dir).select(coerce_path(F.col("file")).alias("path"))
             .where(F.col("path").isNotNull()).distinct())
    up = uploads(spark, sf_dir).join(named, "path", "left_semi")
    h = up.select(F.col("path").alias("file_path"), file_hash(F.col("content")).alias("document_hash"))
    return r.join(h, on="file_path", how="left")



def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers: assistant turns with an answer phrase in front."""
    c = conversations(spark, sf_dir).filter(F.col("role") == "assistant")
    event_id = F.col("conv_id") * S.EVENT_ID_MULT + F.col("turn")
    return c.select(F.col("conv_id").alias("session_id"), event_id.alias("event_id"),
                    salted(F.col("text"), event_id, S.ANSWER_PHRASES, sep="").alias("raw"))


def speech_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a markdown/structure phrase in front."""
    c = conversations(spark, sf_dir).filter(F.col("role") == "assistant")
    event_id = F.col("conv_id") * S.EVENT_ID_MULT + F.col("turn")
    return c.select(event_id.alias("event_id"),
                    salted(F.col("text"), event_id, S.SPEECH_PHRASES, sep="").alias("text"))


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular-extraction pages: each line of a document is one page."""
    lines = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("pos", "text")
    return documents(spark, sf_dir).select("doc_id", lines).select("doc_id", (F.col("pos") + 1).alias("page_no"), "text")


def ocr_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR candidates per page, each a reading of the whole line: ``hindi``
    keeps what is not a Latin letter, ``english`` what is ASCII, ``combined``
    the whole line (its language fails on every fourth page). Candidates are
    stripped; blank ones and failed languages are absent, as in the rules."""
    from chalkline.functions.textops import py_strip
    d = documents(spark, sf_dir)
    lines = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("pos", "line")
    p = d.select("doc_id", lines).select("doc_id", (F.col("pos") + 1).alias("page_no"), "line")
    doc, page, line = F.col("doc_id"), F.col("page_no"), F.col("line")
    hindi = F.regexp_replace(line, "[A-Za-z]", "")
    english = F.regexp_replace(line, "[^\\x00-\\x7F]", "")
    combined = F.when(((doc + page) % 4) != 0, line)
    cands = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("hindi").alias("lang"), py_strip(hindi).alias("text")),
        F.struct(F.lit(1).alias("pos"), F.lit("english").alias("lang"), py_strip(english).alias("text")),
        F.struct(F.lit(2).alias("pos"), F.lit("combined").alias("lang"), py_strip(combined).alias("text")))
    out = (p.select("doc_id", "page_no", (((doc * 3 + page) % 29) == 0).alias("failed"),
                    F.explode(cands).alias("c"))
           .select("doc_id", "page_no", "failed", "c.pos", "c.lang", "c.text")
           .filter(F.col("text").isNotNull() & (F.col("text") != "")))
    return out


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages and candidates above, held as arrays of the document row. Every seventh document is a scan (its regular
    pages hold no text), so U3 takes the OCR path for it."""
    from chalkline.functions.textops import py_strip
    d = documents(spark, sf_dir)
    doc = F.col("doc_id")
    x = d.select("doc_id", F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("lines"))

    def page(line, i):
        return F.struct((i + 1).alias("page_no"), F.when(doc % 7 == 0, F.lit("")).otherwise(line).alias("text"))

    def reading(pos, lang, text):
        return F.struct(F.lit(pos).alias("pos"), F.lit(lang).alias("lang"), py_strip(text).alias("text"))

    def scan(line, i):
        combined = F.when(((doc + i + 1) % 4) != 0, line)
        return F.struct((i + 1).alias("page_no"), (((doc * 3 + i + 1) % 29) == 0).alias("failed"),
                        F.array(reading(0, "hindi", F.regexp_replace(line, "[A-Za-z]", "")),
                                reading(1, "english", F.regexp_replace(line, "[^\\x00-\\x7F]", "")),
                                reading(2, "combined", combined)).alias("candidates"))

    return x.select("doc_id", F.transform("lines", page).alias("regular"), F.transform("lines", scan).alias("ocr"))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every OCR page of every document, including pages with no candidate."""
    d = documents(spark, sf_dir)
    lines = F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("pos", "line")
    p = d.select("doc_id", lines).select("doc_id", (F.col("pos") + 1).alias("page_no"))
    return p.select("doc_id", "page_no", (((F.col("doc_id") * 3 + F.col("page_no")) % 29) == 0).alias("failed"))


def content_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter files: document ``d`` is chapter ``2*(d div 6)+1`` of subject
    ``d % 6`` (odd chapters only, so even chapters are missing)."""
    d = documents(spark, sf_dir)
    subject = pick(S.CATALOG_SUBJECTS, F.col("doc_id") % 6)
    chapter = ((F.col("doc_id") / 6).cast("long") * 2 + 1).cast("int")
    path = F.concat(F.lit("content/"), subject, F.lit("/chapter"), chapter.cast("string"), F.lit(".pdf"))
    return d.select(subject.alias("subject"), chapter.alias("chapter"), path.alias("path"), "text")
