"""Preparing an answer for speech synthesis (T3), live and legacy variants.

The steps are ordered rewrites over the whole string. Two of them choose
their replacement by what they matched; each is written so that a single
left-to-right pass decides, as in the rules:

* parenthesised asides are first marked once with private-use sentinels,
  then the marked spans are rewritten (two conditional replacements in a
  row would let the first expose an outer parenthesis to the second);
* "label: value" lines are rewritten per line of one split, so a line that
  loses its newline cannot merge into the next line's test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.textops import WS_CLASS, col_of, contains_any, ends_with_any, py_strip

_WS = WS_CLASS
_OPEN, _CLOSE = "\ue000", "\ue001"   # sentinels; text is assumed free of them
_INNER = "[^" + _OPEN + _CLOSE + "]"


def _asides(t: Column) -> Column:
    t = F.regexp_replace(t, r"\(([^()\n]+)\)", _OPEN + "$1" + _CLOSE)
    t = F.regexp_replace(t, _OPEN + _WS + "*" + _CLOSE, "")
    t = F.regexp_replace(t, _OPEN + _WS + "*(" + _INNER + "*?[.!?])" + _WS + "*" + _CLOSE, ". $1 ")
    return F.regexp_replace(t, _OPEN + _WS + "*(" + _INNER + "*?)" + _WS + "*" + _CLOSE, ". $1. ")


def _label_lines(t: Column) -> Column:
    lines = F.split(t, "\n")
    last = F.size(lines) - 1

    def one(line, i):
        s = py_strip(line)
        return (F.when(i == last, line)
                .when(line.rlike("(?s):."),
                      F.concat(s, F.when(ends_with_any(s, [".", "!", "?"]), F.lit(" ")).otherwise(F.lit(". "))))
                .otherwise(F.concat(line, F.lit("\n"))))

    return F.array_join(F.transform(lines, one), "")


def _steps(variant: str, preserve_parentheses: bool):
    """(guard, rewrite) of each step in order; where the guard is false the rewrite changes nothing."""
    live = variant == "live"
    marks = "*`–-" if live else "*`-"
    marked = "|".join([r"\*\*", r"\*", "__", "~~", *marks[1:]])

    def has(*parts):
        return lambda t: contains_any(t, parts)

    # single marks go one by one; only pairs need the alternation, whose matches depend on each other
    steps = [(has("__", "~~"), lambda t: F.regexp_replace(t, marked, "")),
             (has(*marks), lambda t: F.translate(t, marks, ""))]
    if live or not preserve_parentheses:
        steps.append((has("("), _asides))
    bullets = r"[\*\-•]" if live else r"[\*\->]"
    return [*steps,
            (has("."), lambda t: F.regexp_replace(t, r"(\p{Nd}+\." + _WS + r"*)([^\n]+)", "$1$2.")),
            (has("English meaning:"), lambda t: F.regexp_replace(t, r"(English meaning:[^\n]*?)\n", "$1. ")),
            (has(":"), _label_lines),
            (has("-"), lambda t: F.regexp_replace(t, _WS + "-" + _WS, ". ")),
            (has("*", "-", "•" if live else ">"), lambda t: F.regexp_replace(t, "\n" + _WS + "*" + bullets + _WS + "*", ". ")),
            (None, lambda t: F.regexp_replace(t, _WS + "{2,}", " ")),
            (None, lambda t: py_strip(F.replace(t, F.lit("\n"), F.lit(" "))))]


def speech_text(text, variant: str = "live", preserve_parentheses: bool = False) -> Column:
    """Strip markdown and turn structure into spoken pauses.

    ``live`` ignores ``preserve_parentheses``; ``legacy`` honours it, keeps
    en dashes, and turns ``>`` bullets (not ``•``) into pauses. As one
    expression it runs every step; on tables use :func:`with_speech_text`.
    """
    t = col_of(text)
    for _, rewrite in _steps(variant, preserve_parentheses):
        t = rewrite(t)
    return t


def with_speech_text(df: DataFrame, text: str, out: str, variant: str = "live", preserve_parentheses: bool = False) -> DataFrame:
    """T3 on a table. Every step is a column of its own projection, referred to by the next one's guard and rewrite, so
    the optimiser keeps them apart and a text runs only the regular expressions that can match it."""
    step = f"_t3_{out}"
    df = df.withColumn(step, col_of(text))
    for guard, rewrite in _steps(variant, preserve_parentheses):
        t = F.col(step)
        df = df.withColumn(step, rewrite(t) if guard is None else F.when(guard(t), rewrite(t)).otherwise(t))
    return df.withColumnRenamed(step, out)
