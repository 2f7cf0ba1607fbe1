"""Session content text: header + body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.textops import col_of


def _py_bool(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def content_info_repr(info) -> Column:
    """The content info as Python writes a dict of it (keys in insertion order)."""
    i = col_of(info)
    return F.concat(F.lit("{'type': '"), i["type"], F.lit("', 'subject': '"), i["subject"],
                    F.lit("', 'has_questions': "), _py_bool(i["has_questions"]),
                    F.lit(", 'has_exercises': "), _py_bool(i["has_exercises"]),
                    F.lit(", 'confidence': "), i["confidence"].cast("string"), F.lit("}"))


def format_session_content(info, body) -> Column:
    """``CONTENT_TYPE: {info}`` + blank line + body."""
    return F.concat(F.lit(R.SESSION_CONTENT_HEAD), content_info_repr(info), F.lit("\n\n"),
                    F.coalesce(col_of(body), F.lit("")))


def split_session_content(raw) -> Column:
    """The body of a stored session text.

    With the header marker anywhere in the text, the body is everything
    after the first blank line (the whole text when there is none);
    otherwise the text is the body."""
    r = col_of(raw)
    cut = F.instr(r, "\n\n")
    return F.when(r.contains(R.SESSION_CONTENT_MARKER) & (cut > 0), F.substr(r, cut + 2)).otherwise(r)
