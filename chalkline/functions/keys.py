"""Cache keys and stored-audio paths.

The cache key is the SHA-256 of the payload serialised exactly as Python's
``json.dumps(payload, sort_keys=True, ensure_ascii=True,
separators=(",", ":"))``: keys in alphabetical order, no spaces, non-ASCII
and control characters as lower-case ``\\uXXXX`` escapes (UTF-16 units, so
an emoji becomes a surrogate pair). Keys are therefore identical to the
ones in an index written by the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.textops import col_of, path_suffix

_SHORT_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"),
                  ("\b", "\\b"), ("\f", "\\f")]


def _escape_char(c: Column) -> Column:
    out = None
    for raw, esc in _SHORT_ESCAPES:
        out = (F.when(c == raw, F.lit(esc)) if out is None else out.when(c == raw, F.lit(esc)))
    units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
    return (out.when(c.rlike("^[\\x20-\\x7e]$"), c)
            .otherwise(F.regexp_replace(units, "([0-9a-f]{4})", "\\\\u$1")))


def json_string(s) -> Column:
    """A JSON string literal as Python's ``json.dumps(..., ensure_ascii=True)``
    writes it; ``null`` for null. Strings that are plain printable ASCII
    take a fast path; others are escaped character by character."""
    s = col_of(s)
    needs_escape = s.rlike('[^\\x20-\\x7e]|["\\\\]')
    slow = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)(.)"), 1), _escape_char), "")
    body = F.when(needs_escape, slow).otherwise(s)
    return F.when(s.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_int(n) -> Column:
    n = col_of(n)
    return F.when(n.isNull(), F.lit("null")).otherwise(n.cast("string"))


def payload_json(intent, subject, chapter_number, content_source, student_query, document_hash) -> Column:
    """The six-field cache payload serialised with sorted keys."""
    fields = [("chapter_number", json_int(chapter_number)),
              ("content_source", json_string(content_source)),
              ("document_hash", json_string(document_hash)),
              ("intent", json_string(intent)),
              ("student_query", json_string(F.coalesce(col_of(student_query), F.lit("")))),
              ("subject", json_string(subject))]
    parts = [F.lit("{")]
    for i, (name, value) in enumerate(fields):
        parts += [F.lit(("," if i else "") + '"' + name + '":'), value]
    parts.append(F.lit("}"))
    return F.concat(*parts)


def cache_key(intent, subject, chapter_number, content_source, student_query, document_hash) -> Column:
    """SHA-256 hex of the serialised payload."""
    return F.sha2(payload_json(intent, subject, chapter_number, content_source, student_query, document_hash), 256)


def payload_struct(intent, subject, chapter_number, content_source, student_query, document_hash) -> Column:
    """The payload as the ``meta`` struct stored next to a response (fields in
    alphabetical order)."""
    return F.struct(col_of(chapter_number).cast("int").alias("chapter_number"),
                    col_of(content_source).alias("content_source"),
                    col_of(document_hash).alias("document_hash"),
                    col_of(intent).alias("intent"),
                    F.coalesce(col_of(student_query), F.lit("")).alias("student_query"),
                    col_of(subject).alias("subject"))


def meta_key(meta) -> Column:
    """T14 recomputed from a stored ``meta`` struct."""
    m = col_of(meta)
    return cache_key(m["intent"], m["subject"], m["chapter_number"], m["content_source"],
                     m["student_query"], m["document_hash"])


def file_hash(content) -> Column:
    """SHA-256 hex of a file's bytes; null when the bytes are absent."""
    return F.sha2(col_of(content), 256)


def stored_audio_path(key, source_path, audio_dir, copied=None) -> Column:
    """Where a response's audio is kept: ``<dir>/<key><suffix>`` with
    ``.mp3`` when the source has no suffix; the source path itself when the
    copy did not happen; null when there is no audio."""
    src = col_of(source_path)
    suffix = path_suffix(src)
    ext = F.when(suffix == "", F.lit(R.DEFAULT_AUDIO_SUFFIX)).otherwise(suffix)
    stored = F.concat(col_of(audio_dir), F.lit("/"), col_of(key), ext)
    ok = F.lit(True) if copied is None else F.coalesce(col_of(copied), F.lit(False))
    return (F.when(src.isNull() | (src == ""), src)
            .when(ok, stored)
            .otherwise(src))


def needs_audio(text, audio_path) -> Column:
    """A cached entry with text but no audio must be synthesised."""
    t, a = col_of(text), col_of(audio_path)
    return F.coalesce(t != "", F.lit(False)) & (a.isNull() | (a == ""))
