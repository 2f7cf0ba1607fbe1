"""Branch coverage on the salted driver tables (sf0.01): each rule arm that
the derived inputs are built to reach must fire at least once."""

import pytest
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.plans.queries import QUERIES
from tests.conftest import SF01


def _values(spark, q, col):
    return {r[0] for r in QUERIES[q](spark, SF01).select(col).distinct().collect()}


@pytest.mark.parametrize("query,col,expected", [
    ("content_type", "subject", {"math", "english", "science", "history", "geography", "hindi", "unknown"}),
    ("content_type", "type", {"homework", "textbook", "general"}),
    ("content_type_legacy", "subject", {"math", "english", "science", "history", "geography", "unknown"}),
    ("detect_language", "language", {"hi", "en"}),
    ("question_rules", "is_specific", {True, False}),
    ("question_rules", "help_type", {"terms", "solution", "explanation", "general"}),
    ("question_rules", "upload_kind", {"pdf", "image", "unsupported"}),
    ("route_requests", "intent", {"smart_first_response", "greeting", "follow_up"}),
    ("cache_replay", "hit", {True, False}),
    ("cache_lookup", "hit", {True, False}),
    ("extraction_choice", "method", {"regular", "ocr"}),
    ("pick_ocr_text", "lang", {"hindi", "english", "combined"}),
    ("document_intake", "method", {"regular", "ocr"}),
    ("document_intake", "reply_is_error", {True, False}),
    ("answer_worklist", "action", {"serve", "synthesize_audio", "reply_status", "generate"}),
    ("answer_worklist", "reply", {R.UPLOAD_ERROR_REPLY, R.UNSUPPORTED_UPLOAD_REPLY}),
    ("store_answers", "speech_lang", {"hi", "en"}),
    ("resolve_content", "status", {"camera", "missing", "ok", "unsupported"}),
    ("quick_actions", "accepted", {True, False}),
    ("prompts", "task", {"teaching_task", "smart_response_task", "follow_up_task", "document_analysis_task"}),
    ("clean_answers", "speech_lang", {"hi", "en"}),
])
def test_arms_fire(spark, query, col, expected):
    assert expected <= _values(spark, query, col)


def test_documents_and_replay_arms(spark):
    cd = QUERIES["current_document"](spark, SF01)
    assert cd.filter(F.col("doc_event_id").isNull()).count() > 0
    assert cd.filter(F.col("doc_event_id").isNotNull()).count() > 0
    # a follow-up keeps the document that its session has stored
    assert cd.filter(F.col("doc_event_id") < F.col("event_id")).count() > 0
    pr = QUERIES["prompts"](spark, SF01).filter("task = 'document_analysis_task'")
    assert pr.agg(F.max("prompt_chars") - F.min("prompt_chars")).first()[0] > 1000      # with and without a document's text
    rp = QUERIES["replay_turn"](spark, SF01)
    assert rp.filter(F.col("replay_text") == "").count() > 0 and rp.filter(F.col("replay_text") != "").count() > 0
    ca = QUERIES["clean_answers"](spark, SF01)
    assert ca.filter("has_marker").count() > 0 and ca.filter("reply != cleaned").count() > 0


def test_document_intake_no_text_arm(spark):
    out = QUERIES["document_intake"](spark, SF01)
    assert out.filter(F.col("type").isNull()).count() > 0 and out.filter(F.col("type").isNotNull()).count() > 0
