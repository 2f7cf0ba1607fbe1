"""File sources: chapter catalog, uploads, text decoding.

Files are listed and read by Spark's ``binaryFile`` source, one row per
file spread over tasks. PDF parsing and OCR are outside this engine; page
text arrives as tables (see ``operators.documents``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.textops import col_of


def content_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Chapter files ``<root>/<subject>/chapter<n>.pdf`` keyed by
    (lower-cased subject, chapter). Only paths and sizes are read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "chapter*.pdf")
             .option("recursiveFileLookup", "true").load(root))
    m = r"/([^/]+)/chapter([0-9]+)\.pdf\z"
    return files.select(F.lower(F.regexp_extract("path", m, 1)).alias("subject"),
                        F.regexp_extract("path", m, 2).try_cast("int").alias("chapter"),
                        "path", "length").filter(F.col("chapter").isNotNull())


def scan_uploads(spark: SparkSession, directory: str, with_content: bool = True,
                 max_bytes: int | None = None) -> DataFrame:
    """Uploaded files with their bytes. ``with_content=False`` prunes the
    content column so only the listing is read. A file over ``max_bytes`` keeps
    its row with null content and status ``too_large``, and is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    if not with_content:
        return files.select("path", "length")
    if max_bytes is None:
        return files.select("path", "length", "content", F.lit("ok").alias("status"))
    read = files.filter(F.col("length") <= max_bytes).select("path", "length", "content", F.lit("ok").alias("status"))
    large = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("status"))
    return read.unionByName(large)


_CP1252_FROM = "".join(chr(b) for b in R.CP1252_UPPER)
_CP1252_TO = "".join(R.CP1252_UPPER.values())
_LATIN1_ONLY = "[" + "".join("\\x{%02X}" % b for b in R.CP1252_UNDEFINED) + "]"


def decode_text(content) -> Column:
    """``struct<text, encoding>`` by the fallback order utf-8, utf-8-sig,
    cp1252, latin-1 (first that decodes wins).

    A UTF-8 BOM is reported as utf-8 and kept; bytes undefined in cp1252
    fall through to latin-1. Line ends are read as a text-mode reader
    reads them (CRLF and CR become LF)."""
    b = col_of(content)
    as_utf8 = b.cast("string")
    latin1 = F.decode(b, "ISO-8859-1")
    encoding = (F.when(F.is_valid_utf8(as_utf8), F.lit("utf-8"))
                .when(latin1.rlike(_LATIN1_ONLY), F.lit("latin-1"))
                .otherwise(F.lit("cp1252")))
    text = (F.when(encoding == "utf-8", as_utf8)
            .when(encoding == "latin-1", latin1)
            .otherwise(F.translate(latin1, _CP1252_FROM, _CP1252_TO)))
    return F.struct(F.regexp_replace(text, "\r\n?", "\n").alias("text"), encoding.alias("encoding"))
