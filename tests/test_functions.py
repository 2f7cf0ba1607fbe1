"""Golden rows for the Column rule functions (hand-traced from the rules)."""

from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.content import detect_language, identify_content_type
from chalkline.functions.questions import (chapter_int, fallback_for_unknown, help_type,
                                           is_specific_question, is_tool_error, normalize_question,
                                           route_intent)
from chalkline.functions.responses import clean_response
from chalkline.functions.speech import speech_text
from tests.conftest import one_col


def test_normalize_question(spark):
    cases = [
        ("Please explain the hard words and their English meanings",
         "Please explain the difficult words and their English meanings"),
        ("Can you tell me the meaning of the words?", "Can you tell me the meanings of difficult words?"),
        ("I need the meanings of tricky words", "I need the meanings of difficult words"),
        ("Their english meanings are confusing", "their English meanings are confusing"),
        ("  HARD WORDS  ", "difficult words"),
        ("hardwords", "hardwords"),
        ("", ""), (None, None), ("   ", ""),
    ]
    got = one_col(spark, [c[0] for c in cases], normalize_question)
    assert got == [c[1] for c in cases]


def test_normalize_idempotent(spark):
    vals = ["the hard words", "Tricky Words and their english meanings", "meaning of the words"]
    once = one_col(spark, vals, normalize_question)
    twice = one_col(spark, once, normalize_question)
    assert once == twice


def test_reference_unit_tests(spark):
    # the reference's own three unit tests, as substring assertions
    inputs = ["Please explain the hard words and their English meanings",
              "Can you tell me the meaning of the words?",
              "I need the meanings of tricky words",
              "Their english meanings are confusing"]
    expected = ["difficult words", "meanings of difficult words", "difficult words", "English meanings"]
    got = one_col(spark, inputs, normalize_question)
    for g, e in zip(got, expected):
        assert e.lower() in g.lower()
    df = spark.createDataFrame([("Hindi", inputs[0]), ("Math", "What is the score of the cricket match?")],
                               "s string, q string")
    r = df.select(fallback_for_unknown("s", "q").alias("y")).collect()
    assert "difficult words" in r[0].y.lower() or "meaning" in r[0].y.lower()
    assert "cricket" not in r[1].y.lower() and "math" in r[1].y.lower()


def test_fallback_for_unknown(spark):
    df = spark.createDataFrame([("Math", "sword"), ("Math", "vocabulary list"), ("Math", None)],
                               "s string, q string")
    r = [x.y for x in df.select(fallback_for_unknown("s", "q").alias("y")).collect()]
    assert r[0] == R.VOCAB_REPLY and r[1] == R.VOCAB_REPLY
    assert r[2] == R.REDIRECT_REPLY_HEAD + "Math" + R.REDIRECT_REPLY_TAIL


def test_is_specific_question(spark):
    true_ = ["Show me the map", "hello how are you", "Why?"]
    false_ = ["", "ok", "Hi?", "hello how are", "history?", "Chapter one", "??", None]
    assert one_col(spark, true_, is_specific_question) == [True] * 3
    assert one_col(spark, false_, is_specific_question) == [False] * len(false_)


def test_route_intent(spark):
    rows = [(True, "Why is sky blue?", "Chapter", R.INTENT_SMART),
            (True, "Chapter one", "Chapter", R.INTENT_GREETING),
            (True, "", R.SOURCE_CAMERA, R.INTENT_GREETING),
            (False, "", "Chapter", R.INTENT_GREETING),
            (False, "", R.SOURCE_CAMERA, R.INTENT_FOLLOW_UP),
            (False, "Chapter one", "Chapter", R.INTENT_FOLLOW_UP),
            (False, None, None, R.INTENT_GREETING)]
    df = spark.createDataFrame(rows, "f boolean, m string, s string, e string")
    for r in df.select(route_intent("f", "m", "s").alias("y"), "e").collect():
        assert r.y == r.e


def test_chapter_int(spark):
    got = one_col(spark, ["7", "0", "x", " 7 ", "", None, "12", "99999999999"], chapter_int)
    assert got == [7, 1, 1, 1, 1, 1, 12, 99999999999]


def test_is_tool_error(spark):
    got = one_col(spark, [None, "", "I can only help with PDF files", "You asked: 'Please upload?'",
                          "please upload", "Great! I can see this is study material."], is_tool_error)
    assert got == [True, True, True, True, False, False]


def test_help_type(spark):
    got = one_col(spark, ["define atom", "what does it mean", "how to add", "show answer", "explain why",
                          "show", "ok"], help_type)
    assert got == ["terms", "terms", "solution", "solution", "explanation", "explanation", "general"]


def test_identify_content_type(spark):
    cases = [
        ("Solve the algebra homework: what is 2+2?", ("homework", "math", True, True, 0.9)),
        ("This chapter tells a story", ("textbook", "english", False, False, 0.8)),
        ("नदी और पर्वत", ("general", "geography", False, False, 0.8)),
        ("कविता और भाषा", ("general", "english", False, False, 0.8)),
        ("प्रयोग", ("general", "science", False, True, 0.8)),
        ("roadmap", ("general", "geography", False, False, 0.8)),
        ("aftermath", ("general", "math", False, False, 0.8)),
        ("unsolved", ("homework", "unknown", True, True, 0.9)),
        ("a lesson", ("textbook", "unknown", False, False, 0.8)),
        ("", ("general", "unknown", False, False, 0.5)),
        ("जोड़", ("general", "math", False, False, 0.8)),
    ]
    got = one_col(spark, [c[0] for c in cases], identify_content_type)
    assert [tuple(g) for g in got] == [c[1] for c in cases]


def test_detect_language(spark):
    hi = ["नमस्ते", "नमस्ते hello", "क ab"]
    en = ["hello", "", "123", "।।।", "क abc", "ककक abcdefg", None]
    assert one_col(spark, hi, detect_language) == ["hi"] * 3
    assert one_col(spark, en, detect_language) == ["en"] * len(en)


def test_clean_response(spark):
    fb = R.CLEAN_FALLBACK
    cases = [
        ("Thought: I need to greet\nHello dear student, welcome to class!", "Hello dear student, welcome to class!"),
        (None, ""), ("", ""), ("   ", fb), ("ok", fb), ("Yes, correct!", "Yes, correct!"),
        ("Let me explain photosynthesis.", fb),
        ("Plants need water.\n\n\nAnd they need sunlight too.", "Plants need water.\nAnd they need sunlight too."),
        ("The word thought means an idea in mind.", "The word means an idea in mind."),
        # paragraph rescue: cleaned text is short, the last clean long paragraph wins
        # a short last paragraph is skipped, the search goes on to an earlier one
        ("Keeping calm helps a lot, friend.\n\nok", "Keeping calm helps a lot, friend."),
        ("Let me think.\n\nI should say the answer is 42 friend.\n\nok", fb),
    ]
    got = one_col(spark, [c[0] for c in cases], clean_response)
    assert got == [c[1] for c in cases]


def test_speech_text_live(spark):
    cases = [
        ("**Hello** (friend)", "Hello . friend."),
        ("1. Add\n2. Sub", "1. Add. 2. Sub."),
        ("Note: be kind\nNext", "Note: be kind. Next"),
        ("Note: done!\nNext", "Note: done! Next"),
        ("a - b", "a b"),
        ("Intro\n• one\n• two", "Intro. one. two"),
        ("well-known", "wellknown"),
        ("3.14 is pi", "3.14 is pi."),
        ("()", "()"),
        ("((a!) b)", "(. a! b)"),
        ("A: b!\nplain\nend", "A: b! plain end"),
    ]
    got = one_col(spark, [c[0] for c in cases], speech_text)
    assert got == [c[1] for c in cases]


def test_speech_text_legacy(spark):
    got = one_col(spark, ["Intro\n> one", "a – b", "(keep) it"],
                  lambda c: speech_text(c, variant="legacy", preserve_parentheses=True))
    assert got == ["Intro. one", "a – b", "(keep) it"]


def test_coerce_path(spark):
    from chalkline.functions.questions import coerce_path, coerce_path_list
    df = spark.createDataFrame([(("p", "n", "o"),), (("", "n", "o"),), ((None, "", "o"),), ((None, None, ""),), (None,)],
                               "f struct<path:string,name:string,orig_name:string>")
    assert [r.x for r in df.select(coerce_path("f").alias("x")).collect()] == ["p", "n", "o", "", None]
    lst = spark.createDataFrame([([("", "n", "o"), ("p2", "", "")],)],
                                "f array<struct<path:string,name:string,orig_name:string>>")
    assert lst.select(coerce_path_list("f").alias("x")).collect()[0].x == "n"


def test_small_predicates(spark):
    from chalkline.functions.questions import has_enough_text, has_tool_marker, route_source
    assert one_col(spark, ["x record_unknown_question", "RECORD_UNKNOWN_QUESTION", None], has_tool_marker) == \
        [True, True, False]
    assert one_col(spark, ["RECORD_UNKNOWN_QUESTION"], lambda c: has_tool_marker(c, case_insensitive=False)) == [False]
    assert one_col(spark, ["a" * 51, " " + "a" * 50 + " ", None, ""], has_enough_text) == [True, False, False, False]
    assert one_col(spark, ["Upload PDF", R.SOURCE_CAMERA, "Chapter", "other", None], route_source) == \
        ["upload", "camera", "chapter", "chapter", "chapter"]


def test_upload_prompt_and_tool_replies(spark):
    from chalkline.functions.questions import tool_reply, upload_prompt
    df = spark.createDataFrame([("greeting", R.SOURCE_CAMERA, None), ("follow_up", R.SOURCE_CAMERA, ""),
                                ("greeting", "Upload PDF", None), ("greeting", "Chapter", None),
                                ("greeting", R.SOURCE_CAMERA, "a.png")], "i string, s string, p string")
    got = [r.x for r in df.select(upload_prompt("i", "s", "p").alias("x")).collect()]
    assert got == [R.CAMERA_PROMPT_GREETING, R.CAMERA_PROMPT_QUESTION, R.NOT_FOUND_HEAD + R.NO_PDF_UPLOADED, None, None]
    t = spark.createDataFrame([("unknown_question", "Math"), ("user_details", "Math")], "k string, s string")
    assert [r.x for r in t.select(tool_reply("k", "s").alias("x")).collect()] == [
        "That's an interesting thought! But let's focus on Math. What would you like to learn today?",
        "Thank you for sharing your details! Let's continue learning."]


def test_default_response(spark):
    from chalkline.functions.responses import default_response
    rows = [("greeting", "", "Math", None), ("greeting", "x record_unknown_question", "Math", None),
            ("smart_first_response", "see RECORD_UNKNOWN_QUESTION", "Math", "word list"),
            ("follow_up", "", "Math", "q"), ("camera_first", "", "Math", None), ("camera_follow_up", "", "Math", None),
            ("follow_up", "fine answer here", "Math", "q")]
    df = spark.createDataFrame(rows, "f string, c string, s string, q string")
    got = [r.x for r in df.select(default_response("f", "c", "s", "q").alias("x")).collect()]
    greet = R.GREETING_DEFAULT_HEAD + "Math" + R.GREETING_DEFAULT_TAIL
    assert got == [greet, greet, R.VOCAB_REPLY, R.CLARIFY_DEFAULT, R.CAMERA_EMPTY_DEFAULT, R.CLARIFY_DEFAULT,
                   "fine answer here"]


def test_help_reply_and_file_hash(spark):
    import hashlib
    from chalkline.functions.keys import file_hash
    from chalkline.functions.templates import help_reply
    df = spark.createDataFrame([("  ", True), ("define atom", False), ("define atom", True), ("ok", True)],
                               "q string, d boolean")
    got = [r.x for r in df.select(help_reply("q", "d").alias("x")).collect()]
    assert got[0] == R.BLANK_DOCUMENT_QUESTION_REPLY and got[1] == R.NO_DOCUMENT_REPLY
    assert got[2] == R.HELP_TEMPLATES["terms"][0] + "define atom" + R.HELP_TEMPLATES["terms"][1]
    assert got[3] == R.HELP_TEMPLATES["general"][0] + "ok" + R.HELP_TEMPLATES["general"][1]
    b = spark.createDataFrame([(b"%PDF-1.4 abc",), (None,)], "c binary")
    assert [r.h for r in b.select(file_hash("c").alias("h")).collect()] == \
        [hashlib.sha256(b"%PDF-1.4 abc").hexdigest(), None]


def test_upload_prompt_with_raw_record(spark):
    from chalkline.functions.questions import error_reply, upload_prompt
    rows = [("greeting", R.SOURCE_CAMERA, None, None), ("greeting", R.SOURCE_CAMERA, None, (None, None, None)),
            ("smart_first_response", R.SOURCE_CAMERA, None, (None, None, None)),
            ("follow_up", R.SOURCE_CAMERA, None, (None, None, None)), ("greeting", R.SOURCE_CAMERA, "a.png", ("a.png", "", ""))]
    df = spark.createDataFrame(rows, "i string, s string, p string, f struct<path:string,name:string,orig_name:string>")
    got = [r.x for r in df.select(upload_prompt("i", "s", "p", F.col("f")).alias("x")).collect()]
    assert got == [R.CAMERA_PROMPT_GREETING, R.CAMERA_PROMPT_PLAIN, R.CAMERA_PROMPT_PLAIN, R.CAMERA_PROMPT_QUESTION, None]
    e = spark.createDataFrame([("greeting",), ("follow_up",), ("upload_tool",), ("other",)], "f string")
    assert [r.x for r in e.select(error_reply("f").alias("x")).collect()] == [
        R.GENERIC_ERROR_REPLIES["greeting"], R.GENERIC_ERROR_REPLIES["follow_up"], R.UPLOAD_ERROR_REPLY, None]
