"""Golden rows for table operators and sources (FIXTURES section 4), plus
properties: idempotence, order independence, partition-count independence."""

import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.keys import cache_key, needs_audio, stored_audio_path
from chalkline.functions.questions import speech_lang
from chalkline.functions.templates import fill_template, helpful_response
from chalkline.functions.content import identify_content_type
from chalkline.operators import asof, cache, documents as docs, sessions
from chalkline.sources.files import decode_text
from chalkline.sources.session_content import format_session_content, split_session_content
from tests.conftest import one_col


def test_pick_ocr_text(spark):
    # lengths of hindi / english / combined; None = candidate absent
    cases = [(25, 100, 30, "hindi"), (10, 100, 30, "combined"), (20, 100, 20, "english"),
             (10, 15, 12, "english"), (10, 10, None, "hindi"), (None, 100, 15, "english")]
    rows = []
    for page, case in enumerate(cases):
        for pos, (lang, n) in enumerate(zip(["hindi", "english", "combined"], case[:3])):
            if n is not None:
                rows.append((1, page, pos, lang, lang[0] * n))
    df = spark.createDataFrame(rows, "doc_id long, page_no int, pos int, lang string, text string")
    got = {r.page_no: r.text for r in docs.pick_ocr_text(df).collect()}
    for page, case in enumerate(cases):
        assert got[page][0] == case[3][0], (page, got[page])
    arr = df.groupBy("page_no").agg(F.collect_list(F.struct("pos", "lang", "text")).alias("c"))
    got2 = {r.page_no: r.t for r in arr.select("page_no", docs.pick_ocr_array(F.col("c")).alias("t")).collect()}
    assert got2 == got


def test_assemble_pages_styles(spark):
    pages = spark.createDataFrame([(1, 3, "b"), (1, 1, "a"), (1, 2, "")], "doc_id long, page_no int, text string")
    out = {s: docs.assemble_pages(pages.repartition(3), s).collect()[0].text for s in docs.STYLES}
    assert out == {"chapter": "ab", "upload": "a\nb", "regular": "a\nb",
                   "ocr": "--- Page 1 ---\na\n\n--- Page 2 ---\n\n\n--- Page 3 ---\nb"}


def test_truncate_at_failure(spark):
    pages = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False)],
                                  "doc_id long, page_no int, failed boolean")
    kept = sorted((r.doc_id, r.page_no) for r in docs.truncate_at_failure(pages).collect())
    assert kept == [(1, 1), (2, 1)]


def test_admit_upload(spark):
    names = ["a.pdf", "g.tar.pdf", "b.JPG", "c.jpeg", "d.png", "e.bmp", "f.docx", "noext", ".pdf", "dir/x.PDF/"]
    got = one_col(spark, names, docs.admit_upload)
    assert got == ["pdf", "pdf", "image", "image", "image", "image", "unsupported", "unsupported", "unsupported", "pdf"]
    assert one_col(spark, ["a.pdf", "b.png"], lambda c: docs.admit_upload(c, "strict")) == ["pdf", "unsupported"]


def test_split_session_content(spark):
    got = one_col(spark, ["CONTENT_TYPE: x\n\nbody\n\nmore", "plain\n\ntext", "CONTENT_TYPE: x", None],
                  split_session_content)
    assert got == ["body\n\nmore", "plain\n\ntext", "CONTENT_TYPE: x", None]


def test_session_content_round_trip_and_header(spark):
    df = spark.createDataFrame([("Solve the algebra homework: what is 2+2?\n\nmore",)], "t string")
    r = df.select(format_session_content(identify_content_type(F.col("t")), F.col("t")).alias("s")).collect()[0].s
    info = {"type": "homework", "subject": "math", "has_questions": True, "has_exercises": True, "confidence": 0.9}
    assert r == f"CONTENT_TYPE: {info}\n\n" + "Solve the algebra homework: what is 2+2?\n\nmore"
    back = spark.createDataFrame([(r,)], "s string").select(split_session_content("s").alias("b")).collect()[0].b
    assert back == "Solve the algebra homework: what is 2+2?\n\nmore"


def test_decode_text(spark):
    df = spark.createDataFrame([(bytes([0xEF, 0xBB, 0xBF, 0x41]),), (bytes([0x93, 0x41]),), (bytes([0x81]),),
                                ("a\r\nb".encode(),)], "b binary")
    got = [tuple(r.d) for r in df.select(decode_text("b").alias("d")).collect()]
    assert got == [("﻿A", "utf-8"), ("“A", "cp1252"), ("\x81", "latin-1"), ("a\nb", "utf-8")]


def _py_key(p):
    return hashlib.sha256(json.dumps(p, sort_keys=True, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()


def test_cache_key_properties(spark):
    rows = [("greeting", "Math", 1, R.SOURCE_CAMERA, None, None), ("greeting", "Math", 1, R.SOURCE_CAMERA, "", None),
            ("greeting", "Math", 1, R.SOURCE_CAMERA, "", ""), ("follow_up", "हिंदी", 3, "Chapter", "क्या?", "ab")]
    df = spark.createDataFrame(rows, "i string, s string, c int, src string, q string, h string")
    keys = [r.k for r in df.select(cache_key("i", "s", "c", "src", "q", "h").alias("k")).collect()]
    assert keys[0] == keys[1]          # null and empty query give the same key
    assert keys[1] != keys[2]          # null and empty document hash differ
    for (i, s, c, src, q, h), k in zip(rows, keys):
        # field order of the payload does not matter; keys equal the reference's
        assert k == _py_key({"subject": s, "intent": i, "student_query": q or "", "chapter_number": c,
                             "document_hash": h, "content_source": src})


def _log(spark, keys):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(minutes=i), i, f"answer{i}") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "key string, ts timestamp, event_id long, response string")


def test_cache_replay(spark):
    out = cache.cache_replay(_log(spark, ["A", "B", "A", "A"]).repartition(3)).orderBy("event_id").collect()
    assert [r.hit for r in out] == [False, False, True, True]
    assert [r.served_text for r in out] == ["answer0", "answer1", "answer0", "answer0"]


def test_upsert_responses_idempotent(spark):
    schema = "key string, text string, audio_path string, meta string, version long"
    cur = spark.createDataFrame([("k1", "x", None, None, 1)], schema)
    upd = spark.createDataFrame([("k1", "y", None, None, 2), ("k2", "z", None, None, 2)], schema)
    once = cache.upsert_responses(cur, upd)
    twice = cache.upsert_responses(once, upd)
    assert sorted((r.key, r.text) for r in once.collect()) == [("k1", "y"), ("k2", "z")]
    assert sorted(once.collect()) == sorted(twice.collect())


def test_cache_lookup(spark):
    reqs = _log(spark, ["A", "B", "C"])
    idx = spark.createDataFrame([("A", "t", None, None, 1)], "key string, text string, audio_path string, "
                                "meta string, version long")
    out = {r.key: (r.hit, r.cached_text) for r in cache.cache_lookup(reqs, idx).collect()}
    assert out == {"A": (True, "t"), "B": (False, None), "C": (False, None)}
    assert sorted(r.key for r in cache.cache_misses(reqs, idx).collect()) == ["B", "C"]
    assert [r.key for r in cache.cache_hits(reqs, idx).collect()] == ["A"]


def test_current_document(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    docs_ = spark.createDataFrame([(1, t(0), 10, "d0"), (1, t(3), 13, "d1"), (1, t(9), 19, "d9")],
                                  "session_id long, ts timestamp, event_id long, doc_event_id string")
    qs = spark.createDataFrame([(1, t(1), 11), (1, t(5), 15), (2, t(6), 26), (1, t(-1), 9), (1, t(3), 13)],
                               "session_id long, ts timestamp, event_id long")
    for width in (3600, 60, 86400):
        out = {r.event_id: (r.doc.doc_event_id if r.doc else None)
               for r in asof.current_document(qs, docs_, bucket_seconds=width).collect()}
        assert out == {11: "d0", 15: "d1", 26: None, 9: None, 13: "d1"}, width


def test_number_turns_bucket_independent(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(s, base + dt.timedelta(minutes=37 * i + s), 100 * s + i) for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id long, ts timestamp, event_id long")
    want = {(s, 100 * s + i): i + 1 for s in range(3) for i in range(40)}
    for width in (60, 3600, 10 ** 9):
        got = {(r.session_id, r.event_id): r.turn for r in sessions.number_turns(df, bucket_seconds=width).collect()}
        assert got == want
    first = {r.event_id for r in sessions.mark_first(df).filter("is_first").collect()}
    assert first == {0, 100, 200}


def test_replay_turn(spark):
    turns = spark.createDataFrame([(1, 1, "u1", "t1", "a1"), (1, 2, "u2", "t2", None)],
                                  "session_id long, turn int, user string, teacher string, audio string")
    picks = spark.createDataFrame([(1, "Turn 2"), (1, "Turn 0"), (1, "Turn 3"), (1, "abc"), (1, None)],
                                  "session_id long, label string")
    got = {r.label: (r.replay_text, r.replay_audio) for r in sessions.replay_turn(turns, picks).collect()}
    assert got == {"Turn 2": ("t2", None), "Turn 0": ("", None), "Turn 3": ("", None), "abc": ("", None),
                   None: ("", None)}


def test_render_transcript(spark):
    turns = spark.createDataFrame([(1, 1, "hi", "Hello")], "session_id long, turn int, user string, teacher string")
    r = sessions.render_transcript(turns).collect()[0]
    assert r.transcript == "### 💬 Turn 1\n\n---\n\n**You:** hi\n\n---\n\n**Teacher:** Hello"


def test_upgrade_history(spark):
    df = spark.createDataFrame([('[["u","t"],["u2","t2"]]',), ('[{"user":"u","teacher":"t","audio":"a"}]',)], "h string")
    got = [[tuple(e) for e in r.x] for r in df.select(sessions.upgrade_history("h").alias("x")).collect()]
    assert got == [[("u", "t", None), ("u2", "t2", None)], [("u", "t", "a")]]


def test_quick_actions(spark):
    df = spark.createDataFrame([("explain",), ("draw",)], "action string")
    ok, bad = sessions.expand_quick_action(df)
    assert [r.message for r in ok.collect()] == [R.QUICK_ACTIONS[0][1]]
    assert [r.action for r in bad.collect()] == ["draw"]


def test_pair_turns(spark):
    conv = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
                                  (1, 3, "user", "q2")], "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in sessions.pair_turns(conv).collect())
    assert got == [(1, 1, "q1", "a1"), (1, 3, "q2", None)]


def test_speech_lang_and_audio_paths(spark):
    df = spark.createDataFrame([("greeting", "HINDI", ""), ("greeting", "Math", ""), ("camera_first", "Math", "a Hindi poem"),
                                ("document_question", "Hindi", "")], "f string, s string, r string")
    assert [r.l for r in df.select(speech_lang("f", "s", "r").alias("l")).collect()] == ["hi", "en", "hi", "en"]
    a = spark.createDataFrame([("k", "/t/a.wav"), ("k", "/t/noext"), ("k", None)], "k string, p string")
    assert [r.x for r in a.select(stored_audio_path("k", "p", F.lit("d")).alias("x")).collect()] == \
        ["d/k.wav", "d/k.mp3", None]
    n = spark.createDataFrame([("t", None), ("t", "p"), ("", None)], "t string, a string")
    assert [r.x for r in n.select(needs_audio("t", "a").alias("x")).collect()] == [True, False, False]


def test_templates(spark):
    df = spark.createDataFrame([("x $1 {subject}",)], "q string")
    got = df.select(fill_template("Q: {student_query} / {subject}",
                                  {"student_query": F.col("q"), "subject": F.lit("Math")}).alias("p")).collect()[0].p
    assert got == "Q: x $1 {subject} / Math"          # student text is inserted verbatim, never re-scanned
    info = spark.createDataFrame([("This chapter tells a story",)], "t string")
    r = info.select(helpful_response(identify_content_type(F.col("t")), F.lit("why?")).alias("x")).collect()[0].x
    assert r.startswith("Great! I can see this is a English textbook content. You asked: 'why?'\n\n")


def test_resolve_content_golden(spark):
    # FIXTURES J1: known chapter ok; unknown chapter missing; empty chapter text unreadable; chapter text of
    # spaces ok; upload text of spaces unreadable; upload .docx unsupported; upload mode without file missing
    reqs = spark.createDataFrame([
        (1, "Math", "1", "Chapter", None), (2, "Math", "2", "Chapter", None), (3, "Hindi", "1", "Chapter", None),
        (4, "Science", "1", "Chapter", None), (5, "Math", "1", "Upload PDF", "u/a.pdf"),
        (6, "Math", "1", "Upload PDF", "u/f.docx"), (7, "Math", "1", "Upload PDF", None),
        (8, "Math", "1", R.SOURCE_CAMERA, "u/a.pdf"), (9, "Math", "1", "Upload PDF", "u/gone.pdf"),
        (10, "Math", "1", "Upload PDF", "u/b.pdf")],
        "event_id long, subject string, chapter string, content_source string, file_path string")
    catalog = spark.createDataFrame([("math", 1, "content/math/chapter1.pdf", "text"),
                                     ("hindi", 1, "content/hindi/chapter1.pdf", ""),
                                     ("science", 1, "content/science/chapter1.pdf", "   ")],
                                    "subject string, chapter int, path string, text string")
    uploads = spark.createDataFrame([("u/a.pdf", "   "), ("u/f.docx", "words"), ("u/b.pdf", "body")],
                                    "path string, text string")
    uploads = uploads.select("path", docs.py_strip(F.col("text")).alias("text"))
    out = {r.event_id: (r.status, r.content, r.status_message)
           for r in docs.resolve_content(reqs, catalog, uploads).collect()}
    assert out[1][:2] == ("ok", "text")
    assert out[2][0] == "missing" and out[2][2].startswith(R.NOT_FOUND_HEAD + "Content not found: content/math/chapter2.pdf")
    assert out[3][0] == "unreadable" and out[3][2] == (R.UNREADABLE_HEAD + "PDF has no extractable text: "
                                                        "content/hindi/chapter1.pdf. Consider using OCR for scanned documents.")
    assert out[4][:2] == ("ok", "   ")
    assert out[5][0] == "unreadable" and out[5][2] == R.UNREADABLE_HEAD + R.UPLOAD_NO_TEXT
    assert out[6][0] == "unsupported" and out[6][2] == R.UNREADABLE_HEAD + "Unsupported file type: .docx. Please upload a .pdf"
    assert out[7] == ("missing", "", R.NOT_FOUND_HEAD + R.NO_PDF_UPLOADED)
    assert out[8][:2] == ("camera", "")
    assert out[9][2] == R.NOT_FOUND_HEAD + "Uploaded file not found: u/gone.pdf"
    assert out[10][:2] == ("ok", "body")


def test_transcript_pages_join_to_whole(spark):
    rows = [(1, t, f"u{t}", f"t{t}") for t in range(1, 8)]
    turns = spark.createDataFrame(rows, "session_id long, turn int, user string, teacher string")
    whole = sessions.render_transcript(turns).collect()[0].transcript
    pages = sorted(sessions.render_transcript(turns, page_turns=3).collect(), key=lambda r: r.page)
    assert [r.n_turns for r in pages] == [3, 3, 1]
    assert R.TRANSCRIPT_SEPARATOR.join(r.transcript for r in pages) == whole
