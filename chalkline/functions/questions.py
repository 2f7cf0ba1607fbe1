"""Column rules for student messages and request fields.

Each function takes Columns (or column names) and returns a Column built
only from built-in expressions: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.textops import (col_of, contains_any, is_blank, py_strip,
                                         startswith_any, token_count)


def normalize_question(q) -> Column:
    """Strip, then whole-phrase, case-insensitive rewrites in order.

    Null and empty stay as they are.
    """
    q = col_of(q)
    out = py_strip(q)
    for phrase, replacement in R.NORMALIZE_REWRITES:
        # (?iU): Unicode case folding and Unicode word boundaries, as Python's re
        out = F.regexp_replace(out, r"(?iU)\b" + phrase + r"\b", replacement)
    return F.when(q.isNull() | (q == ""), q).otherwise(out)


def is_specific_question(msg) -> Column:
    """P5: a real question or request, and not just a short greeting."""
    m = F.coalesce(col_of(msg), F.lit(""))
    stripped = py_strip(m)
    low = py_strip(F.lower(m))
    asks = m.contains("?") | contains_any(low, R.QUESTION_WORDS)
    just_greeting = startswith_any(low, R.GENERIC_GREETINGS) & (token_count(low) <= 3)
    return (F.length(stripped) >= 3) & asks & ~just_greeting


def help_type(question) -> Column:
    """Which kind of help a document question asks for (first match)."""
    low = F.lower(F.coalesce(col_of(question), F.lit("")))
    return (F.when(contains_any(low, R.HELP_TERMS_WORDS), "terms")
            .when(contains_any(low, R.HELP_SOLUTION_WORDS), "solution")
            .when(contains_any(low, R.HELP_EXPLANATION_WORDS), "explanation")
            .otherwise("general"))


def fallback_for_unknown(subject, query) -> Column:
    """Vocabulary help when the query mentions words, else a redirect."""
    low = F.lower(F.coalesce(col_of(query), F.lit("")))
    redirect = F.concat(F.lit(R.REDIRECT_REPLY_HEAD), F.coalesce(col_of(subject), F.lit("None")),
                        F.lit(R.REDIRECT_REPLY_TAIL))
    return F.when(contains_any(low, R.VOCAB_KEYWORDS), F.lit(R.VOCAB_REPLY)).otherwise(redirect)


def chapter_int(chapter) -> Column:
    """All-digit text to its number (a long); anything else, and 0, to 1."""
    c = col_of(chapter)
    n = F.when(c.rlike(r"^[0-9]+\z"), c.try_cast("long"))
    return F.coalesce(F.nullif(n, F.lit(0)), F.lit(1))


def coerce_path(file) -> Column:
    """P1 for a ``struct<path,name,orig_name>``: first non-empty of path and
    name, else ``orig_name`` as it is; a missing record gives null."""
    f = col_of(file)
    return F.when(f.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.nullif(f["path"], F.lit("")), F.nullif(f["name"], F.lit("")), f["orig_name"]))


def coerce_path_list(files) -> Column:
    """P1 for a list of records: the first element decides."""
    return coerce_path(F.get(col_of(files), 0))


def is_tool_error(text) -> Column:
    """Empty, or holds one of the case-sensitive error markers."""
    t = col_of(text)
    return t.isNull() | (t == "") | F.coalesce(contains_any(t, R.TOOL_ERROR_MARKERS), F.lit(False))


def has_tool_marker(text, case_insensitive: bool = True) -> Column:
    """The answer names the unknown-question tool."""
    t = F.coalesce(col_of(text), F.lit(""))
    return (F.lower(t) if case_insensitive else t).contains(R.TOOL_MARKER)


def has_enough_text(text) -> Column:
    """Regular extraction is good enough (stripped length over 50)."""
    t = col_of(text)
    return F.coalesce(F.length(py_strip(t)) > R.REGULAR_TEXT_MIN_LENGTH, F.lit(False))


def route_source(source) -> Column:
    """Where a request's content comes from."""
    s = col_of(source)
    return (F.when(s == R.SOURCE_UPLOAD, "upload")
            .when(s == R.SOURCE_CAMERA, "camera")
            .otherwise("chapter"))


def is_empty_message(msg) -> Column:
    return is_blank(msg)


def route_intent(is_first, msg, source) -> Column:
    """Smart first answer, greeting or follow-up for one request."""
    first = col_of(is_first)
    src = col_of(source)
    empty = is_empty_message(msg)
    not_camera = src.isNull() | (src != R.SOURCE_CAMERA)
    return (F.when(first & ~empty & is_specific_question(msg), F.lit(R.INTENT_SMART))
            .when(first | (empty & not_camera), F.lit(R.INTENT_GREETING))
            .otherwise(F.lit(R.INTENT_FOLLOW_UP)))


def cache_query(intent, msg) -> Column:
    """The query text a request is cached under: the normalised message,
    and nothing for a greeting."""
    m = col_of(msg)
    normalized = F.when(m.isNull() | (m == ""), F.lit("")).otherwise(normalize_question(m))
    return F.when(col_of(intent) == R.INTENT_GREETING, F.lit("")).otherwise(normalized)


def upload_prompt(intent, source, path, file=None) -> Column:
    """P10: the reply a request gets when its mode needs a file and has none.

    Camera mode: with no file at all, a greeting or first question gets its
    own upload prompt; a follow-up whose file gives no path gets the question
    prompt. When ``file`` (the raw record) is given, a greeting or first
    question whose record gives no path gets the plain document prompt.
    Upload mode without a file is a not-found reply."""
    src, p, it = col_of(source), col_of(path), col_of(intent)
    missing = p.isNull() | (p == "")
    raw_missing = missing if file is None else col_of(file).isNull()
    camera = src == R.SOURCE_CAMERA
    follow = it == R.INTENT_FOLLOW_UP
    return (F.when(camera & follow & missing, F.lit(R.CAMERA_PROMPT_QUESTION))
            .when(camera & raw_missing & (it == R.INTENT_GREETING), F.lit(R.CAMERA_PROMPT_GREETING))
            .when(camera & raw_missing, F.lit(R.CAMERA_PROMPT_QUESTION))
            .when(camera & missing, F.lit(R.CAMERA_PROMPT_PLAIN))
            .when((src == R.SOURCE_UPLOAD) & missing, F.lit(R.NOT_FOUND_HEAD + R.NO_PDF_UPLOADED)))


def error_reply(flow) -> Column:
    """The reply of a flow that failed unexpectedly; ``upload_tool`` is the
    upload tool's own error reply."""
    fl = col_of(flow)
    out = F.when(fl == "upload_tool", F.lit(R.UPLOAD_ERROR_REPLY))
    for name, text in R.GENERIC_ERROR_REPLIES.items():
        out = out.when(fl == name, F.lit(text))
    return out


def tool_reply(kind, subject) -> Column:
    """Fixed reply of the off-topic and user-details tools."""
    k = col_of(kind)
    return (F.when(k == "unknown_question",
                   F.concat(F.lit(R.UNKNOWN_QUESTION_REPLY_HEAD), F.coalesce(col_of(subject), F.lit("None")),
                            F.lit(R.UNKNOWN_QUESTION_REPLY_TAIL)))
            .when(k == "user_details", F.lit(R.USER_DETAILS_REPLY)))


def speech_lang(flow, subject, response) -> Column:
    """Speech language by flow."""
    fl = col_of(flow)
    return (F.when(fl == "camera_first", F.when(F.lower(F.coalesce(col_of(response), F.lit(""))).contains("hindi"),
                                                 "hi").otherwise("en"))
            .when(fl == "document_question", F.lit("en"))
            .when(F.lower(col_of(subject)) == "hindi", F.lit("hi"))
            .otherwise(F.lit("en")))
