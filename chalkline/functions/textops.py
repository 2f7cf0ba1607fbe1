"""Small Column helpers shared by the rule functions.

Python string semantics the rules depend on, written as built-in Spark
expressions so they stay inside whole-stage codegen:

* ``str.strip()`` / ``str.split()`` use Python's whitespace set, wider than
  Spark's ``trim`` (space only); ``py_strip`` trims that exact set.
* ``in`` is a substring test; ``any(...)`` over a list is an OR chain of
  ``contains`` (measured faster than one ``rlike`` alternation).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.rules import PY_WHITESPACE


def _class_escape(ch: str) -> str:
    return "\\x{%X}" % ord(ch)


def _ranges(chars: str) -> str:
    """Character-class body with consecutive code points merged into ranges."""
    cps = sorted({ord(c) for c in chars})
    out, start, prev = [], cps[0], cps[0]
    for cp in cps[1:] + [None]:
        if cp is not None and cp == prev + 1:
            prev = cp
            continue
        out.append(_class_escape(chr(start)) if start == prev
                   else _class_escape(chr(start)) + "-" + _class_escape(chr(prev)))
        if cp is not None:
            start = prev = cp
    return "".join(out)


# A regex character class equal to Python's whitespace set (as ranges, which
# regex engines test faster than long member lists); valid in Java regex and
# in RE2, so Spark and the DuckDB oracle share it.
WS_CLASS = "[" + _ranges(PY_WHITESPACE) + "]"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: trim Python whitespace from both ends."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def contains_any(c, words) -> Column:
    c = col_of(c)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def startswith_any(c, words) -> Column:
    c = col_of(c)
    return reduce(lambda a, b: a | b, [c.startswith(w) for w in words])


def token_count(c) -> Column:
    """``len(s.split())`` for an already stripped string."""
    c = col_of(c)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, WS_CLASS + "+")))


def is_blank(c) -> Column:
    """``not s or not s.strip()``."""
    c = col_of(c)
    return c.isNull() | (py_strip(c) == "")


def ends_with_any(c, suffixes) -> Column:
    c = col_of(c)
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])


def path_name(c) -> Column:
    """Final path segment (``PurePath.name``), trailing slashes ignored."""
    return F.regexp_extract(col_of(c), r"([^/]*)/*\z", 1)


def path_suffix(c) -> Column:
    """``PurePath.suffix``: last ``.ext`` of the name; dot-files have none."""
    return F.regexp_extract(path_name(c), r"^.+(\.[^.]+)\z", 1)


def sql_str(s: str) -> str:
    """A SQL string literal (for Spark SQL fragments and the DuckDB oracle)."""
    return "'" + s.replace("'", "''") + "'"
