"""Property tests on random inputs (hypothesis). Each example is a batch of
random values evaluated in one Spark job."""

import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chalkline.functions.keys import cache_key
from chalkline.functions.questions import normalize_question
from chalkline.functions.responses import clean_response
from chalkline.functions.speech import speech_text
from chalkline.sources.files import decode_text
from tests.conftest import one_col

SETTINGS = settings(max_examples=4, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

# text drawn from the characters the rules care about, plus arbitrary Unicode
ALPHABET = st.sampled_from(list("abcdefghijklmnopqrstuvwxyz ABCHTW?:.!-*_~`()•>\n\t\r12345") +
                           ["नमस्ते", "क", "्", "é", "ü", "📱", " ", " ", "hard words", "Thought:",
                            "their english meanings", "Let me", "**", "English meaning: x\n"])
RICH_TEXT = st.lists(ALPHABET, max_size=40).map("".join)
ANY_TEXT = st.text(max_size=30)


@SETTINGS
@given(st.lists(st.one_of(RICH_TEXT, ANY_TEXT), min_size=40, max_size=40))
def test_normalize_is_idempotent(spark, values):
    once = one_col(spark, values, normalize_question)
    assert one_col(spark, once, normalize_question) == once


@SETTINGS
@given(st.lists(st.one_of(RICH_TEXT, ANY_TEXT), min_size=40, max_size=40))
def test_speech_text_shape(spark, values):
    for out in one_col(spark, values, speech_text):
        assert "\n" not in out and "**" not in out and "`" not in out
        assert out == out.strip()
        # runs of two or more whitespace characters collapse; a single tab may stay
        assert not any(a.isspace() and b.isspace() for a, b in zip(out, out[1:]))


@SETTINGS
@given(st.lists(st.one_of(RICH_TEXT, ANY_TEXT), min_size=40, max_size=40))
def test_clean_response_shape(spark, values):
    for raw, out in zip(values, one_col(spark, values, clean_response)):
        if raw == "":
            assert out == ""
        else:
            assert out == out.strip() and len(out) >= 10 and "\n\n\n" not in out


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["greeting", "follow_up"]), st.one_of(st.none(), ANY_TEXT, RICH_TEXT),
                          st.integers(0, 10 ** 6), st.one_of(st.none(), ANY_TEXT),
                          st.one_of(st.none(), ANY_TEXT, RICH_TEXT), st.one_of(st.none(), ANY_TEXT)),
                min_size=30, max_size=30))
def test_cache_key_equals_python_json(spark, rows):
    df = spark.createDataFrame(rows, "i string, s string, c int, src string, q string, h string")
    keys = [r.k for r in df.select(cache_key("i", "s", "c", "src", "q", "h").alias("k")).collect()]
    for (i, s, c, src, q, h), k in zip(rows, keys):
        payload = {"intent": i, "subject": s, "chapter_number": c, "content_source": src,
                   "student_query": q or "", "document_hash": h}
        text = json.dumps(payload, sort_keys=True, ensure_ascii=True, separators=(",", ":"))
        assert k == hashlib.sha256(text.encode("utf-8")).hexdigest()


def _python_decode(b: bytes):
    for enc in ("utf-8", "cp1252", "latin-1"):
        try:
            text = b.decode(enc)
        except UnicodeDecodeError:
            continue
        return text.replace("\r\n", "\n").replace("\r", "\n"), enc
    raise AssertionError("latin-1 decodes every byte string")


@SETTINGS
@given(st.lists(st.one_of(st.binary(max_size=20), RICH_TEXT.map(lambda t: t.encode("utf-8")),
                          st.binary(max_size=8).map(lambda b: b"\xef\xbb\xbf" + b)), min_size=40, max_size=40))
def test_decode_text_equals_python_codecs(spark, blobs):
    df = spark.createDataFrame([(b,) for b in blobs], "b binary")
    got = [tuple(r.d) for r in df.select(decode_text("b").alias("d")).collect()]
    assert got == [_python_decode(b) for b in blobs]


def test_speech_on_tables_equals_the_expression(spark):
    """The guarded steps of ``with_speech_text`` leave out nothing that the plain expression rewrites."""
    import itertools

    from pyspark.sql import functions as F

    from chalkline.functions.speech import speech_text, with_speech_text
    parts = ["_*_", "~__~", "_~~_", "**b** `c` – d-e", "(aside)", "((a!) b)", "1. one", "English meaning: x\n", "label: v\n", "\n• b", "\n > q", "  \n ", "plain."]
    texts = ["".join(p) for n in (1, 2, 3) for p in itertools.permutations(parts, n)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for variant, keep in (("live", False), ("legacy", False), ("legacy", True)):
        out = with_speech_text(df, "text", "out", variant, keep).withColumn("want", speech_text(F.col("text"), variant, keep))
        assert out.filter(~F.col("out").eqNullSafe(F.col("want"))).count() == 0
