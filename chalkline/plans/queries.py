"""Registered queries: one per operator group of the inventory.

Each takes ``(spark, sf_dir)``, reads the driver tables (through the
derived inputs of ``plans.inputs``) and returns a DataFrame whose column
names match the DuckDB oracle in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.content import detect_language, devanagari_count, letter_count, with_content_info
from chalkline.functions.keys import cache_key, file_hash, needs_audio, stored_audio_path
from chalkline.functions.questions import (cache_query, chapter_int, coerce_path, fallback_for_unknown,
                                           has_tool_marker, help_type, is_specific_question, is_tool_error,
                                           normalize_question, route_intent, route_source, speech_lang,
                                           tool_reply, upload_prompt)
from chalkline.functions.responses import clean_response, default_response
from chalkline.functions.speech import with_speech_text
from chalkline.functions.textops import is_blank, py_strip
from chalkline.functions.templates import helpful_response, help_reply, render_prompt
from chalkline.operators import asof, cache, documents as docs, sessions
from chalkline.plans import inputs as I
from chalkline.plans import salt as S
from chalkline.session import materialize
from chalkline.sources.session_content import format_session_content, split_session_content
from chalkline.sources.files import decode_text


# --------------------------------------------------------------------------- documents
def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: content type and language of every document, grouped."""
    d = I.content_documents(spark, sf_dir)
    info = with_content_info(d, "text", "ci").select("ci", detect_language(F.col("text")).alias("language"))
    return (info.groupBy(F.col("ci.subject").alias("subject"), F.col("ci.type").alias("type"), "language")
            .agg(F.count(F.lit(1)).alias("n_docs"),
                 F.sum(F.col("ci.has_questions").cast("int")).alias("n_with_questions"),
                 F.sum(F.col("ci.has_exercises").cast("int")).alias("n_with_exercises"),
                 F.sum(F.round(F.col("ci.confidence") * 10).cast("int")).alias("confidence_tenths")))


def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.content_documents(spark, sf_dir)
    return with_content_info(d, "text", "ci").select("doc_id", "ci.*")


def content_type_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.content_documents(spark, sf_dir)
    return with_content_info(d, "text", "ci", legacy=True).select("doc_id", "ci.*")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.language_documents(spark, sf_dir)
    return d.select("doc_id", detect_language(F.col("text")).alias("language"),
                    devanagari_count(F.col("text")).alias("n_devanagari"),
                    letter_count(F.col("text")).alias("n_letters"))


# --------------------------------------------------------------------------- requests
def question_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, P5, T6, T9, P3, P8, P1, P2, P4 on every request."""
    r = I.requests(spark, sf_dir)
    fp = coerce_path(F.col("file"))
    return r.select(
        "event_id",
        normalize_question(F.col("message")).alias("normalized"),
        is_specific_question(F.col("message")).alias("is_specific"),
        help_type(F.col("message")).alias("help_type"),
        fallback_for_unknown(F.col("subject"), F.col("message")).alias("fallback"),
        chapter_int(F.col("chapter")).alias("chapter_no"),
        route_source(F.col("content_source")).alias("source_route"),
        fp.alias("file_path"),
        docs.admit_upload(fp).alias("upload_kind"),
        docs.admit_upload(fp, "strict").alias("strict_kind"),
        is_tool_error(F.col("message")).alias("is_tool_error"),
    )


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # turns are numbered on the bare request log, before the upload-hash join
    r = I.with_upload_hash(spark, sf_dir, sessions.number_turns(I.requests(spark, sf_dir)))
    r = (r.withColumn("intent", route_intent(F.col("turn") == 1, F.col("message"), F.col("content_source")))
         .withColumn("chapter_no", chapter_int(F.col("chapter"))))
    r = r.withColumn("cache_query", cache_query(F.col("intent"), F.col("message")))
    return r.withColumn("key", cache_key(F.col("intent"), F.col("subject"), F.col("chapter_no"),
                                         F.col("content_source"), F.col("cache_query"), F.col("document_hash")))


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + P9 + P3 + T1 + T15 + T14 + P10: intent and cache key of every request."""
    r = _routed(spark, sf_dir)
    return r.select("session_id", "event_id", "turn", "intent", "chapter_no", "cache_query", "document_hash", "key",
                    upload_prompt(F.col("intent"), F.col("content_source"), F.col("file_path")).alias("prompt"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with the reply that followed it in its conversation."""
    c = I.conversations(spark, sf_dir)
    nxt = c.select(F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("conv_turn"),
                   F.when(F.col("role") == "assistant", F.col("text")).alias("reply"))
    return nxt


def _log(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """The routed request log with each request's reply. When two branches
    of one plan read it (``shared``), it is materialised once instead of
    being derived twice."""
    log = (_routed(spark, sf_dir).join(_replies(spark, sf_dir), ["session_id", "conv_turn"], "left")
           .withColumn("response", F.coalesce(F.col("reply"), F.lit(""))))
    return materialize(log) if shared else log


def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log run through an empty cache."""
    out = cache.cache_replay(_log(spark, sf_dir, shared=True))
    return out.select("event_id", "key", "hit", "served_text")


def _entries(log: DataFrame) -> DataFrame:
    from chalkline.functions.keys import payload_struct
    return log.filter(F.col("reply").isNotNull()).select(
        "key", F.col("reply").alias("text"), F.lit(None).cast("string").alias("audio_path"),
        payload_struct(F.col("intent"), F.col("subject"), F.col("chapter_no"), F.col("content_source"),
                       F.col("cache_query"), F.col("document_hash")).alias("meta"),
        F.col("event_id").alias("version"), "conv_turn")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response index: every answered request, the latest answer per key."""
    return cache.latest_entries(_entries(_log(spark, sf_dir)))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request looked up in the index of answered requests."""
    log = _log(spark, sf_dir, shared=True)
    out = cache.cache_lookup(log, cache.latest_entries(_entries(log)))
    return out.select("event_id", "key", "hit", "cached_text")


def upsert_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after the early turns, merged with the later turns' entries."""
    e = _entries(_log(spark, sf_dir, shared=True))
    current = e.filter(F.col("conv_turn") < S.INDEX_CUTOFF_TURN)
    updates = e.filter(F.col("conv_turn") >= S.INDEX_CUTOFF_TURN)
    merged = cache.upsert_responses(current, updates)
    return merged.select("key", "text", "version")


def store_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 -> T12 -> T16 -> U1, then T7 + T3: the index as the flows store it (cleaned answers, or each flow's default), merged
    by key, with the text and the language that the speech of every stored answer is made from."""
    log = _log(spark, sf_dir, shared=True).filter(F.col("reply").isNotNull())
    camera, first = F.col("content_source") == R.SOURCE_CAMERA, F.col("intent") != "follow_up"
    flow = F.when(camera & first, "camera_first").when(camera, "camera_follow_up").otherwise(F.col("intent"))
    raw = I.salted(F.col("reply"), F.col("event_id") + 1, S.ANSWER_PHRASES, sep="")
    x = log.withColumns({"flow": flow, "cleaned": clean_response(raw)})
    answer = default_response(F.col("flow"), F.col("cleaned"), F.col("subject"), F.col("message"))
    audio = stored_audio_path(F.col("key"), F.concat(F.lit("/tmp/tts/"), F.col("event_id").cast("string"), F.lit(".wav")), F.lit("store/audio"))
    meta = F.struct("flow", "subject")
    entries = x.select("key", answer.alias("text"), audio.alias("audio_path"), meta.alias("meta"), F.col("event_id").alias("version"), "conv_turn")
    merged = cache.upsert_responses(entries.filter(F.col("conv_turn") < S.INDEX_CUTOFF_TURN),
                                    entries.filter(F.col("conv_turn") >= S.INDEX_CUTOFF_TURN))
    merged = merged.withColumn("speech_lang", speech_lang(F.col("meta.flow"), F.col("meta.subject"), F.col("text")))
    return with_speech_text(merged, "text", "speech").select("key", "text", "audio_path", "version", "speech_lang", "speech")


def audio_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16 + T17: stored audio path and synthesis work list for the index."""
    idx = _index(spark, sf_dir)
    src = F.when(F.col("version") % 3 == 0, F.lit(None)).when(F.col("version") % 3 == 1, F.lit("/tmp/tts/a.wav")) \
        .otherwise(F.lit("/tmp/tts/noext"))
    x = idx.select("key", "text", src.alias("source_audio"))
    return x.select("key", stored_audio_path(F.col("key"), F.col("source_audio"), F.lit("store/audio")).alias("audio_path"),
                    needs_audio(F.col("text"), F.col("source_audio")).alias("needs_audio"))


# --------------------------------------------------------------------------- answers
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + P6 + P4 + T12 + T7 on every generated answer."""
    a = I.answers(spark, sf_dir)
    asked = I.conversations(spark, sf_dir).filter(F.col("role") == "user").select(
        (F.col("conv_id") * S.EVENT_ID_MULT + F.col("turn") + 1).alias("event_id"), F.col("text").alias("question"))
    a = a.join(asked, "event_id", "left")
    subject = I.pick(S.SUBJECT_CHOICES, F.col("session_id") % 5)
    flow = I.pick(["greeting", "smart_first_response", "follow_up", "camera_first", "camera_follow_up"],
                  F.col("event_id") % 5)
    cleaned = clean_response(F.col("raw"))
    x = a.select("event_id", subject.alias("subject"), flow.alias("flow"), cleaned.alias("cleaned"), "raw", "question")
    reply = default_response(F.col("flow"), F.col("cleaned"), F.col("subject"), F.col("question"))
    return x.select("event_id", "flow", "cleaned",
                    has_tool_marker(F.col("cleaned")).alias("has_marker"),
                    is_tool_error(F.col("raw")).alias("is_tool_error"),
                    reply.alias("reply"),
                    speech_lang(F.col("flow"), F.col("subject"), reply).alias("speech_lang"))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, live and legacy, on every answer."""
    a = I.speech_answers(spark, sf_dir)
    a = with_speech_text(a, "text", "live")
    a = with_speech_text(a, "text", "legacy", variant="legacy")
    return with_speech_text(a, "text", "legacy_keep", variant="legacy", preserve_parentheses=True).drop("text")


# --------------------------------------------------------------------------- sessions
def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.pair_turns(I.conversations(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of every session: numbered requests with their replies."""
    log = _log(spark, sf_dir)
    return log.select("session_id", "turn", sessions.display_message(F.col("message")).alias("user"),
                      F.col("response").alias("teacher"),
                      F.when(F.col("reply").isNotNull(),
                             F.concat(F.lit("store/audio/"), F.col("key"), F.lit(".mp3"))).alias("audio"))


def render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.render_transcript(_turns(spark, sf_dir))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.transcript_lines(_turns(spark, sf_dir))


def replay_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay pick per request, labels cycling through valid and invalid ones."""
    r = I.requests(spark, sf_dir)
    labels = ["Turn 1", "Turn 2", "Turn 0", "Turn 9", "abc", None, " Turn 3 "]
    picks = r.select("session_id", "event_id", I.pick(labels, F.col("event_id") % len(labels)).alias("label"))
    out = sessions.replay_turn(_turns(spark, sf_dir), picks)
    return out.select("event_id", "label", "replay_text", "replay_audio")


def quick_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quick-action press per request; unknown codes are rejected."""
    r = I.requests(spark, sf_dir).select("event_id", I.pick(S.ACTION_CODES, F.col("event_id") % 4).alias("action"))
    ok, bad = sessions.expand_quick_action(r)
    return (ok.withColumn("accepted", F.lit(True))
            .unionByName(bad.withColumn("message", F.lit(None).cast("string")).withColumn("accepted", F.lit(False))))


def camera_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, the documents that camera requests store). The first request of a session reads its upload and
    replaces what is stored; a later one reads it only where nothing is stored (``if_none``). An upload that is of an
    unsupported kind, cannot be read or holds no text stores nothing."""
    r = I.requests(spark, sf_dir).withColumn("file_path", coerce_path(F.col("file"))).select(
        "session_id", "ts", "event_id", "content_source", "file_path", "message")
    d = (sessions.mark_first(r.drop("message"))
         .filter((F.col("content_source") == R.SOURCE_CAMERA) & (docs.admit_upload(F.col("file_path")) != "unsupported")))
    # only uploads that a camera request names are decoded: the aggregate keeps the test of the text behind the semi-join
    named = (r.filter(F.col("content_source") == R.SOURCE_CAMERA).select("file_path").distinct())
    uploads = I.uploads(spark, sf_dir).select(F.col("path").alias("file_path"), "content").join(named, "file_path", "left_semi")
    with_text = (uploads.groupBy("file_path").agg(F.max(py_strip(decode_text(F.col("content"))["text"]) != "").alias("has_text"))
                 .filter("has_text").select("file_path"))
    d = d.join(with_text, "file_path", "left_semi").select(
        "session_id", "ts", "event_id", F.col("event_id").alias("doc_event_id"), F.col("file_path").alias("doc_path"),
        (~F.col("is_first")).alias("if_none"))
    # short rows that the as-of join reads several times; the uploads are read for them once
    return r, materialize(d)


def _seen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, d = camera_documents(spark, sf_dir)
    out = asof.current_document(r.select("session_id", "ts", "event_id", "message"), d, doc_cols=("doc_event_id", "doc_path"))
    return out.select("event_id", "message", F.col("doc.doc_event_id").alias("doc_event_id"), F.col("doc.doc_path").alias("doc_path"))


def current_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document each request sees, by the session's rule of storing."""
    return _seen_documents(spark, sf_dir).drop("message")


def document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 + T6 + T10 over J3: the answer_from_document reply of every request."""
    x = _seen_documents(spark, sf_dir)
    has_doc = F.col("doc_event_id").isNotNull()
    return x.select("event_id", help_type(F.col("message")).alias("help_type"),
                    help_reply(F.col("message"), has_doc).alias("reply"))


def number_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = I.requests(spark, sf_dir)
    return sessions.number_turns(r).select("session_id", "event_id", "turn")


HISTORY_CHUNK_TURNS = 50


def upgrade_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored histories, legacy pairs in even sessions, records in odd
    ones. Histories are stored in chunks of at most 50 turns, so no
    session's history is gathered into one value."""
    t = _turns(spark, sf_dir).withColumn("chunk", ((F.col("turn") - 1) / HISTORY_CHUNK_TURNS).cast("int"))
    pair = F.array(F.col("user"), F.col("teacher"))
    rec = F.struct("user", "teacher", "audio")
    hist = (t.groupBy("session_id", "chunk")
            .agg(F.array_sort(F.collect_list(F.struct("turn", pair.alias("p"), rec.alias("r")))).alias("h")))
    js = F.when(F.col("session_id") % 2 == 0, F.to_json(F.transform("h", lambda x: x["p"]))) \
        .otherwise(F.to_json(F.transform("h", lambda x: x["r"])))
    up = hist.select("session_id", "chunk", sessions.upgrade_history(js).alias("history"))
    return up.select("session_id", "chunk", F.posexplode("history").alias("pos", "entry")).select(
        "session_id", (F.col("chunk") * HISTORY_CHUNK_TURNS + F.col("pos") + 1).alias("turn"),
        "entry.user", "entry.teacher", "entry.audio")


# --------------------------------------------------------------------------- pages and uploads
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 in the chapter, upload and regular styles over regular pages."""
    p = I.pages_text(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return p.groupBy("doc_id").agg(
        F.sha2(docs.assemble_array(ordered, "chapter"), 256).alias("chapter_sha"),
        F.sha2(docs.assemble_array(ordered, "upload"), 256).alias("upload_sha"),
        docs.assemble_array(ordered, "regular").alias("regular_text"))


def pick_ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.pick_ocr_text(I.ocr_candidates(spark, sf_dir))


def truncate_at_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = docs.truncate_at_failure(I.ocr_pages(spark, sf_dir))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages_kept"), F.max("page_no").alias("last_page"))


def extraction_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3 (with W2, A4, W4 and A1): the text extracted from each document."""
    return docs.extraction_choice_nested(I.nested_pages(spark, sf_dir))


def admit_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 + T15 + S7 + T19 on every uploaded file."""
    u = I.uploads(spark, sf_dir)
    dec = decode_text(F.col("content"))
    kind = docs.admit_upload(F.col("path"))
    return u.select("page_id", "path", kind.alias("kind"), docs.admit_upload(F.col("path"), "strict").alias("strict_kind"),
                    file_hash(F.col("content")).alias("sha256"), dec["encoding"].alias("encoding"),
                    F.length(dec["text"]).alias("n_chars"),
                    docs.upload_reply(kind, dec["text"]).alias("reply"))


def resolve_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 (+ T19): content and outcome of every request."""
    r = I.requests(spark, sf_dir).withColumn("file_path", coerce_path(F.col("file")))
    up = I.uploads(spark, sf_dir)
    up_text = up.select("path", decode_text(F.col("content"))["text"].alias("raw"))
    up_text = up_text.select("path", py_strip_text(F.col("raw")).alias("text"))
    out = docs.resolve_content(r, I.content_catalog(spark, sf_dir), up_text)
    return out.select("event_id", "route", "status", F.sha2(F.col("content"), 256).alias("content_sha"),
                      "status_message")


def py_strip_text(c):
    """Upload text as its pages give it: non-empty lines joined, stripped."""
    from chalkline.functions.textops import py_strip
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x != "")
    return py_strip(F.array_join(lines, "\n"))


def session_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 then S5 on every document, and S5 on the raw text."""
    d = I.content_documents(spark, sf_dir)
    # a column of its own projection: it is read several times and made once
    d = with_content_info(d, "text", "ci").withColumn("stored", format_session_content(F.col("ci"), F.col("text")))
    return d.select("doc_id", F.sha2("stored", 256).alias("stored_sha"),
                    (split_session_content(F.col("stored")) == F.col("text")).alias("round_trip"),
                    F.sha2(split_session_content(F.col("text")), 256).alias("raw_split_sha"))


def helpful_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 on every document, with the request's question for even documents."""
    d = I.content_documents(spark, sf_dir)
    q = F.when(F.col("doc_id") % 2 == 0, I.pick(S.QUESTION_PHRASES, F.col("doc_id") % 10))
    return with_content_info(d, "text", "ci").select("doc_id", helpful_response(F.col("ci"), q).alias("reply"))


def tool_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The off-topic and user-details tool replies for every request."""
    r = I.requests(spark, sf_dir)
    kind = F.when(F.col("event_id") % 2 == 0, F.lit("unknown_question")).otherwise(F.lit("user_details"))
    return r.select("event_id", kind.alias("kind"), tool_reply(kind, F.col("subject")).alias("reply"))


def _with_texts(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Requests with what a prompt is made from: the chapter's or upload's text (J1: ``content``, ``status``, ...), and, in
    camera mode, the document the session has stored by then (J3: ``doc_path``, ``document_text``)."""
    up = I.uploads(spark, sf_dir)
    texts = up.select("path", py_strip_text(decode_text(F.col("content"))["text"]).alias("text"))
    resolved = docs.resolve_content(rows, I.content_catalog(spark, sf_dir), texts)
    r, d = camera_documents(spark, sf_dir)
    camera = r.filter(F.col("content_source") == R.SOURCE_CAMERA).select("session_id", "ts", "event_id")
    seen = (asof.current_document(camera, d, doc_cols=("doc_path",)).select("event_id", F.col("doc.doc_path").alias("doc_path"))
            .filter(F.col("doc_path").isNotNull()))
    # only the stored documents' texts are made and shuffled
    stored = texts.join(d.select(F.col("doc_path").alias("path")).distinct(), "path", "left_semi")
    seen = seen.join(stored.select(F.col("path").alias("doc_path"), F.col("text").alias("document_text")), "doc_path", "left")
    known = up.select(F.col("path").alias("file_path"), F.lit(True).alias("file_exists")).join(
        r.select("file_path").distinct(), "file_path", "left_semi")
    return resolved.join(seen, "event_id", "left").join(known, "file_path", "left")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every routed request, with the texts it names (offline-inference input)."""
    r = _with_texts(spark, sf_dir, _routed(spark, sf_dir))
    task = _task(F.col("intent"), F.col("content_source"))
    values = {"subject": F.col("subject"), "chapter_number": F.col("chapter_no").cast("string"),
              "chapter_content": F.col("content"), "student_query": F.col("cache_query"),
              "student_question": F.col("message"), "document_text": F.col("document_text")}
    # a column of its own projection: rendered once, read twice
    r = r.select("event_id", task.alias("task"), render_prompt(task, values).alias("prompt"))
    return r.select("event_id", "task", F.sha2("prompt", 256).alias("prompt_sha"), F.length("prompt").alias("prompt_chars"))


def _task(intent, source):
    t = (F.when(intent == "greeting", F.lit("teaching_task"))
         .when(intent == "smart_first_response", F.lit("smart_response_task"))
         .otherwise(F.lit("follow_up_task")))
    return F.when(source == R.SOURCE_CAMERA, F.lit("document_analysis_task")).otherwise(t)


def answer_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request flow end to end (route, look up, then serve, synthesise,
    reply with a status, or generate): every request of the log against the
    index of the early turns' answers.

    Hits with text but no audio go to speech synthesis (T17); misses are
    resolved to their content (J1): a missing upload prompt (P10) or a
    content problem (T19) is answered directly, everything else becomes a
    prompt row (T13) for offline generation."""
    log = _log(spark, sf_dir, shared=True)
    early = _entries(log).filter(F.col("conv_turn") < S.INDEX_CUTOFF_TURN)
    # every third stored answer has been synthesised already
    early = early.withColumn("audio_path", F.when(F.col("version") % 3 == 0, F.concat(F.lit("audio/"), F.col("key"), F.lit(".mp3"))))
    looked = cache.cache_lookup(log, cache.latest_entries(early))
    resolved = _with_texts(spark, sf_dir, looked)
    prompt = upload_prompt(F.col("intent"), F.col("content_source"), F.col("file_path"))
    # the camera flow refuses unsupported files before anything is generated
    camera_file = (F.col("content_source") == R.SOURCE_CAMERA) & (F.col("file_path") != "")
    refused = F.when(camera_file & (docs.admit_upload(F.col("file_path")) == "unsupported"), F.lit(R.UNSUPPORTED_UPLOAD_REPLY))
    # and one it can read no text from, unless the session has a document stored already
    unread = F.when(camera_file & F.col("doc_path").isNull(),
                    F.when(F.col("file_exists"), F.lit(R.NO_TEXT_UPLOAD_REPLY)).otherwise(F.lit(R.UPLOAD_ERROR_REPLY)))
    reply = F.coalesce(prompt, refused, unread, F.col("status_message"))
    task = _task(F.col("intent"), F.col("content_source"))
    values = {"subject": F.col("subject"), "chapter_number": F.col("chapter_no").cast("string"),
              "chapter_content": F.col("content"), "student_query": F.col("cache_query"),
              "student_question": F.col("message"), "document_text": F.col("document_text")}
    action = (F.when(F.col("hit") & needs_audio(F.col("cached_text"), F.col("cached_audio")),
                     F.lit("synthesize_audio"))
              .when(F.col("hit"), F.lit("serve"))
              .when(reply.isNotNull(), F.lit("reply_status"))
              .otherwise(F.lit("generate")))
    return resolved.select(
        "event_id", "hit", action.alias("action"), "status",
        F.when(action == "reply_status", reply).alias("reply"),
        F.when(action == "generate", task).alias("task"),
        F.when(action == "generate", F.sha2(render_prompt(task, values), 256)).alias("prompt_sha"))


def document_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploaded-document flow: text extraction (U3 with W2, W4, A1), then
    a no-text reply (T19), or the content info (T4), the helpful reply (T8)
    and the stored session text (S6)."""
    ext = docs.extraction_choice_nested(I.nested_pages(spark, sf_dir))
    doc = F.col("doc_id")
    q = (F.when(doc % 2 == 0, I.pick(S.QUESTION_PHRASES, doc % 10))
         .when(doc % 4 == 1, I.pick(S.ERROR_PHRASES, (doc / 4).cast("long") % len(S.ERROR_PHRASES))))
    blank = is_blank(F.col("text"))
    x = with_content_info(ext, "text", "ci").select("doc_id", "method", "text", "ci", q.alias("question"), blank.alias("blank"))
    reply = (F.when(F.col("blank"), F.lit(R.NO_TEXT_UPLOAD_REPLY))
             .otherwise(helpful_response(F.col("ci"), F.col("question"))))
    return x.select(
        "doc_id", "method",
        F.when(~F.col("blank"), F.col("ci.type")).alias("type"),
        F.when(~F.col("blank"), F.col("ci.subject")).alias("subject"),
        reply.alias("reply"),
        # P4 on the tool's reply: an echoed question holding a marker reads as an error
        is_tool_error(reply).alias("reply_is_error"),
        F.when(~F.col("blank"), F.sha2(format_session_content(F.col("ci"), F.col("text")), 256)).alias("stored_sha"))


QUERIES = {
    "document_profile": document_profile,
    "content_type": content_type,
    "content_type_legacy": content_type_legacy,
    "detect_language": language,
    "question_rules": question_rules,
    "number_turns": number_turns,
    "route_requests": route_requests,
    "cache_replay": cache_replay,
    "cache_lookup": cache_lookup,
    "upsert_responses": upsert_responses,
    "store_answers": store_answers,
    "audio_plan": audio_plan,
    "clean_answers": clean_answers,
    "speech_text": speech,
    "pair_turns": pair_turns,
    "render_transcript": render_transcript,
    "transcript_lines": transcript_lines,
    "replay_turn": replay_turn,
    "quick_actions": quick_actions,
    "current_document": current_document,
    "document_answers": document_answers,
    "upgrade_history": upgrade_history,
    "assemble_pages": assemble_pages,
    "pick_ocr_text": pick_ocr_text,
    "truncate_at_failure": truncate_at_failure,
    "extraction_choice": extraction_choice,
    "admit_uploads": admit_uploads,
    "resolve_content": resolve_content,
    "session_content": session_content,
    "helpful_responses": helpful_responses,
    "tool_replies": tool_replies,
    "prompts": prompts,
    "answer_worklist": answer_worklist,
    "document_intake": document_intake,
}
