"""Cleaning generated answers (T2) and the default replies that follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.questions import fallback_for_unknown, has_tool_marker
from chalkline.functions.textops import WS_CLASS, col_of, contains_any, py_strip, startswith_any


def _is_thought(low: Column) -> Column:
    return contains_any(low, R.THOUGHT_PATTERNS)


def clean_response(raw) -> Column:
    """Drop reasoning lines and "thought" words from a generated answer.

    1. null or empty gives ''.
    2. split on newlines, strip, drop blank lines and lines that contain a
       thought phrase or start with a reasoning prefix; join with newlines.
    3. delete ``Thought:`` and the word "thought" with following colons and
       whitespace; collapse runs of blank lines; strip.
    4. shorter than 20: the last paragraph of the original with no thought
       phrase and longer than 20, when there is one.
    5. shorter than 10: a fixed request to repeat the question.
    """
    raw = col_of(raw)
    lines = F.transform(F.split(raw, "\n"), lambda x: py_strip(x))
    kept = F.filter(lines, lambda x: (x != "") & ~_is_thought(F.lower(x))
                    & ~startswith_any(F.lower(x), R.REASONING_PREFIXES))
    cleaned = py_strip(F.array_join(kept, "\n"))
    cleaned = F.regexp_replace(cleaned, "(?i)Thought:" + WS_CLASS + "*", "")
    cleaned = F.regexp_replace(cleaned, r"(?iU)\bThought\b[:" + WS_CLASS[1:-1] + "]*", "")
    cleaned = py_strip(F.regexp_replace(
        cleaned, "\n" + WS_CLASS + "*\n" + WS_CLASS + "*\n", "\n\n"))
    paragraphs = F.filter(F.transform(F.split(raw, "\n\n"), lambda p: py_strip(p)), lambda p: p != "")
    last_good = F.get(F.filter(F.reverse(paragraphs),
                               lambda p: (F.length(p) > 20) & ~_is_thought(F.lower(p))), 0)
    rescued = F.when(F.length(cleaned) < 20, F.coalesce(last_good, cleaned)).otherwise(cleaned)
    return (F.when(raw.isNull() | (raw == ""), F.lit(""))
            .when(F.length(rescued) < 10, F.lit(R.CLEAN_FALLBACK))
            .otherwise(rescued))


def default_response(flow, cleaned, subject, query) -> Column:
    """What a flow answers after cleaning.

    ``greeting``: empty or tool marker gives the canned greeting naming the
    subject. ``smart_first_response`` / ``follow_up``: tool marker gives the
    unknown-question fallback, then empty gives a clarify prompt.
    ``camera_first``: empty gives the processed-document prompt;
    ``camera_follow_up``: empty gives the clarify prompt.
    """
    fl, text = col_of(flow), F.coalesce(col_of(cleaned), F.lit(""))
    empty = text == ""
    greeting = F.concat(F.lit(R.GREETING_DEFAULT_HEAD), F.coalesce(col_of(subject), F.lit("None")),
                        F.lit(R.GREETING_DEFAULT_TAIL))
    return (F.when((fl == "greeting") & (empty | has_tool_marker(text, case_insensitive=False)), greeting)
            .when(fl.isin("smart_first_response", "follow_up") & has_tool_marker(text),
                  fallback_for_unknown(subject, query))
            .when(fl.isin("smart_first_response", "follow_up", "camera_follow_up") & empty,
                  F.lit(R.CLARIFY_DEFAULT))
            .when((fl == "camera_first") & empty, F.lit(R.CAMERA_EMPTY_DEFAULT))
            .otherwise(text))
