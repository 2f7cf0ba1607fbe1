"""Content classification and language detection (T4, T5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.textops import col_of, contains_any

DEVANAGARI_CLASS = "[\\x{%04X}-\\x{%04X}]" % (R.DEVANAGARI_FIRST, R.DEVANAGARI_LAST)

CONTENT_INFO_TYPE = ("struct<type:string,subject:string,has_questions:boolean,"
                     "has_exercises:boolean,confidence:double>")


def has_devanagari(text) -> Column:
    """The text has a character of the block U+0900..U+097F.

    In UTF-8 these, and no others, begin with the bytes E0 A4 or E0 A5; a byte search costs a small part of a regex scan.
    """
    data = col_of(text).cast("binary")
    return F.contains(data, F.lit(bytearray(b"\xe0\xa4"))) | F.contains(data, F.lit(bytearray(b"\xe0\xa5")))


def _in_block(word: str) -> bool:
    return all(R.DEVANAGARI_FIRST <= ord(ch) <= R.DEVANAGARI_LAST or ch == " " for ch in word)


def _any_keyword(low: Column, words, dev: Column) -> Column:
    """``any(w in low for w in words)``. Keywords written in the Devanagari
    block can only occur in a text that has a Devanagari character, so they
    are tested only there: most texts skip those full-text scans."""
    latin = [w for w in words if w.isascii()]
    indic = [w for w in words if not w.isascii()]
    assert all(_in_block(w) for w in indic), indic
    parts = []
    if latin:
        parts.append(contains_any(low, latin))
    if indic:
        parts.append(dev & contains_any(low, indic))
    return parts[0] if len(parts) == 1 else (parts[0] | parts[1])


LIVE_RULES = (R.CONTENT_SUBJECTS, R.HOMEWORK_WORDS, R.TEXTBOOK_WORDS, R.QUESTION_INDICATORS, R.EXERCISE_INDICATORS)
LEGACY_RULES = (R.LEGACY_CONTENT_SUBJECTS, R.LEGACY_HOMEWORK_WORDS, R.LEGACY_TEXTBOOK_WORDS, R.LEGACY_QUESTION_INDICATORS,
                R.LEGACY_EXERCISE_INDICATORS)


def _flags(low: Column, dev: Column, rules) -> dict[str, Column]:
    """What the keyword scans find in a lower-cased text; ``dev``: it has a Devanagari character."""
    subjects, homework, textbook, questions, exercises = rules
    subject = F.lit("unknown")
    for name, words in reversed(subjects):
        subject = F.when(_any_keyword(low, words, dev), F.lit(name)).otherwise(subject)
    return {"subject": subject, "homework": _any_keyword(low, homework, dev), "textbook": _any_keyword(low, textbook, dev),
            "questions": _any_keyword(low, questions, dev), "exercises": _any_keyword(low, exercises, dev)}


def _info(subject: Column, homework: Column, textbook: Column, questions: Column, exercises: Column) -> Column:
    kind = F.when(homework, "homework").when(textbook, "textbook").otherwise("general")
    confidence = (F.when(homework, F.lit(0.9))
                  .when(textbook, F.lit(0.8))
                  .when(subject != "unknown", F.lit(0.8))
                  .otherwise(F.lit(0.5)))
    return F.struct(kind.alias("type"), subject.alias("subject"), questions.alias("has_questions"),
                    exercises.alias("has_exercises"), confidence.alias("confidence"))


def _content_type(text, rules) -> Column:
    low = F.lower(F.coalesce(col_of(text), F.lit("")))
    return _info(**_flags(low, has_devanagari(low), rules))


def identify_content_type(text) -> Column:
    """T4 (live): subject, type, question/exercise flags and confidence.

    All tests are substring tests on the lower-cased text, first subject wins.
    As one expression it lower-cases the text anew for most keywords; on tables
    use :func:`with_content_info`.
    """
    return _content_type(text, LIVE_RULES)


def identify_content_type_legacy(text) -> Column:
    """T4 (legacy): English keywords only, five subjects."""
    return _content_type(text, LEGACY_RULES)


def with_content_info(df: DataFrame, text: str = "text", out: str = "content_info", legacy: bool = False) -> DataFrame:
    """T4 on a table: ``df`` with the content info of ``text`` in ``out``.

    The lower-cased text and what each scan finds are columns of their own projections. Several expressions refer to
    each, so the optimiser keeps the projections apart and every text is lower-cased and scanned once, however often the
    info is used."""
    names = {k: f"_t4_{k}" for k in ("low", "dev", "subject", "homework", "textbook", "questions", "exercises")}
    x = df.withColumn(names["low"], F.lower(F.coalesce(col_of(text), F.lit(""))))
    x = x.withColumn(names["dev"], has_devanagari(F.col(names["low"])))
    found = _flags(F.col(names["low"]), F.col(names["dev"]), LEGACY_RULES if legacy else LIVE_RULES)
    x = x.withColumns({names[k]: c for k, c in found.items()})
    return x.withColumn(out, _info(**{k: F.col(names[k]) for k in found})).drop(*names.values())


def devanagari_count(text) -> Column:
    # runs of other characters are removed, which takes fewer replacements than removing the counted ones
    t = F.coalesce(col_of(text), F.lit(""))
    return F.length(F.regexp_replace(t, "[^" + DEVANAGARI_CLASS[1:-1] + "]+", ""))


def letter_count(text) -> Column:
    t = F.coalesce(col_of(text), F.lit(""))
    return F.length(F.regexp_replace(t, r"\P{L}+", ""))


def detect_language(text) -> Column:
    """T5: ``hi`` when Devanagari-block characters exceed 0.3 of the letters.

    10 * devanagari / letters > 3: of integers, so the quotient is 3 only where it is 3 exactly.
    """
    t = F.coalesce(col_of(text), F.lit(""))
    ratio_says_hi = F.coalesce(devanagari_count(text) * 10 / F.nullif(letter_count(text), F.lit(0)) > 3, F.lit(False))
    # without any Devanagari character the ratio is 0: the counting passes are skipped
    return F.when(has_devanagari(t) & ratio_says_hi, "hi").otherwise("en")
