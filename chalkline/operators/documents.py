"""Document operators: page assembly, OCR choice, upload admission, content
resolution (A1, A4, W2, W4, U3, P2, J1, T19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.questions import chapter_int, has_enough_text, route_source
from chalkline.functions.textops import col_of, path_suffix, py_strip

STYLES = ("chapter", "upload", "regular", "ocr")


def assemble_array(pages, style: str) -> Column:
    """A1 on a page array ``array<struct<page_no,text>>`` already in page order."""
    p = col_of(pages)
    nonempty = F.filter(p, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    if style == "chapter":
        return F.array_join(F.transform(nonempty, lambda x: x["text"]), "")
    if style == "upload":
        return py_strip(F.array_join(F.transform(nonempty, lambda x: x["text"]), "\n"))
    if style == "regular":
        return py_strip(F.array_join(F.transform(nonempty, lambda x: F.concat(x["text"], F.lit("\n"))), ""))
    if style == "ocr":
        return py_strip(F.array_join(F.transform(p, lambda x: F.concat(
            F.lit(R.OCR_PAGE_HEAD), x["page_no"].cast("string"), F.lit(R.OCR_PAGE_TAIL),
            F.coalesce(x["text"], F.lit("")), F.lit("\n"))), ""))
    raise ValueError(f"unknown style {style!r}; expected one of {STYLES}")


def assemble_pages(pages: DataFrame, style: str, key: str = "doc_id", out: str = "text") -> DataFrame:
    """A1: one text per document from its pages, in page order.

    ``chapter``: non-empty pages joined by nothing; ``upload``: non-empty
    pages joined by newlines, stripped; ``regular``: each non-empty page
    plus a newline, stripped; ``ocr``: every page under a ``--- Page n ---``
    header, stripped. The page list is sorted by page number, never left
    in arrival order.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page_no"), F.col("text"))))
    return pages.groupBy(key).agg(assemble_array(ordered, style).alias(out))


def pick_ocr_text(candidates: DataFrame, keys=("doc_id", "page_no")) -> DataFrame:
    """W2 + A4: the OCR text chosen for each page.

    Candidates are tried in the order hindi, english, combined; the first
    hindi or combined candidate longer than 20 characters wins; otherwise
    the longest candidate, the earlier one on a tie. One aggregate per
    page (partial aggregation, no window)."""
    preferred = F.col("lang").isin("hindi", "combined") & (F.length("text") > R.OCR_MIN_PREFERRED_LENGTH)
    rank = F.struct(F.when(preferred, 0).otherwise(1).alias("a"),
                    F.when(preferred, F.col("pos")).otherwise(-F.length("text")).alias("b"),
                    F.col("pos").alias("c"))
    best = candidates.groupBy(*keys).agg(F.min_by(F.struct("lang", "text"), rank).alias("_best"))
    return best.select(*keys, F.col("_best.lang").alias("lang"), F.col("_best.text").alias("text"))


def pick_ocr_array(candidates) -> Column:
    """W2 + A4 on a nested ``array<struct<pos,lang,text>>``: no shuffle."""
    c = F.filter(col_of(candidates), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    preferred = F.filter(c, lambda x: x["lang"].isin("hindi", "combined")
                         & (F.length(x["text"]) > R.OCR_MIN_PREFERRED_LENGTH))
    longest = F.aggregate(c, F.lit(None).cast("struct<pos:int,lang:string,text:string>"),
                          lambda acc, x: F.when(acc.isNull() | (F.length(x["text"]) > F.length(acc["text"])), x)
                          .otherwise(acc))
    first_pref = F.get(F.array_sort(preferred, lambda a, b: a["pos"] - b["pos"]), 0)
    return F.coalesce(first_pref["text"], longest["text"], F.lit(""))


def truncate_at_failure(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keep the pages before a document's first failed page.

    The first failure is a per-document minimum over the failed pages only
    (partial aggregation), joined back to the pages: no window runs over a
    whole document, however many pages it has."""
    first_failure = (pages.filter(F.col("failed")).groupBy(key)
                     .agg(F.min("page_no").alias("_first_failure")))
    return (pages.join(first_failure, key, "left")
            .filter(F.col("_first_failure").isNull() | (F.col("page_no") < F.col("_first_failure")))
            .drop("_first_failure"))


def ocr_text(ocr_pages: DataFrame, candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """OCR extraction of whole documents: W2 per page, pages with no
    candidate read as '', W4 truncation, then A1 ``ocr`` assembly."""
    picked = pick_ocr_text(candidates, (key, "page_no")).drop("lang")
    pages = (ocr_pages.join(picked, [key, "page_no"], "left")
             .withColumn("text", F.coalesce(F.col("text"), F.lit(""))))
    return assemble_pages(truncate_at_failure(pages, key), "ocr", key)


def extraction_choice_nested(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """U3 on documents that hold their pages as arrays, in page order: one pass, no shuffle.

    ``regular`` is ``array<struct<page_no,text>>``, ``ocr`` is
    ``array<struct<page_no,failed,candidates>>`` with the candidates of
    :func:`pick_ocr_array`. W2, W4 and A1 run on the arrays, and the OCR
    side only where the regular text does not suffice."""
    regular = documents.withColumn("_regular", assemble_array(F.col("regular"), "regular"))
    failure = F.array_position(F.transform("ocr", lambda p: p["failed"]), True).cast("int")
    before = F.when(failure == 0, F.col("ocr")).otherwise(F.slice("ocr", 1, F.greatest(failure - 1, F.lit(0))))
    pages = F.transform(before, lambda p: F.struct(p["page_no"].alias("page_no"), pick_ocr_array(p["candidates"]).alias("text")))
    enough = has_enough_text(F.col("_regular"))
    return regular.select(key, F.when(enough, F.lit("regular")).otherwise(F.lit("ocr")).alias("method"),
                          F.when(enough, F.col("_regular")).otherwise(F.coalesce(assemble_array(pages, "ocr"), F.lit(""))).alias("text"))


def extraction_choice(regular_pages: DataFrame, ocr_pages: DataFrame, candidates: DataFrame,
                      key: str = "doc_id") -> DataFrame:
    """Regular text when its stripped length is over 50, else OCR text.

    OCR assembly runs only for the documents that need it (semi-join on
    the remainder), as the reference skips OCR when text suffices."""
    regular = assemble_pages(regular_pages, "regular", key, "regular_text")
    good = regular.filter(has_enough_text(F.col("regular_text")))
    need = regular.filter(~has_enough_text(F.col("regular_text"))).select(key)
    ocr = ocr_text(ocr_pages.join(need, key, "left_semi"), candidates.join(need, key, "left_semi"), key)
    # a document whose first OCR page fails keeps no page: its OCR text is ''
    ocr = need.join(ocr, key, "left").select(key, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return (good.select(key, F.lit("regular").alias("method"), F.col("regular_text").alias("text"))
            .unionByName(ocr.select(key, F.lit("ocr").alias("method"), "text")))


def admit_upload(path, policy: str = "upload") -> Column:
    """``pdf``, ``image`` or ``unsupported`` by lower-cased suffix.

    ``upload`` accepts PDFs and images; ``strict`` (chapter uploads) PDFs only."""
    ext = F.lower(path_suffix(col_of(path)))
    if policy == "strict":
        return F.when(ext == R.PDF_SUFFIX, "pdf").otherwise("unsupported")
    return (F.when(ext == R.PDF_SUFFIX, "pdf")
            .when(ext.isin(*R.IMAGE_SUFFIXES), "image")
            .otherwise("unsupported"))


def resolve_content(requests: DataFrame, catalog: DataFrame, upload_texts: DataFrame) -> DataFrame:
    """The content each request works from, with an outcome status.

    Chapter mode looks up (lower(subject), chapter); its text is not
    stripped, so whitespace-only content is accepted. Upload mode needs a
    file that exists, has a ``.pdf`` suffix and yields text after
    stripping. Camera mode defers to document processing (empty content).
    Both lookups are equi-joins; adaptive execution broadcasts a side only
    when its measured size is small and splits hot keys.

    ``requests`` needs subject, chapter, content_source, file_path;
    ``catalog`` subject (lower-case), chapter, path, text; ``upload_texts``
    path, text.
    """
    cat = catalog.select(F.col("subject").alias("_cat_subject"), F.col("chapter").alias("_cat_chapter"),
                         F.col("path").alias("chapter_path"), F.col("text").alias("_chapter_text"))
    up = upload_texts.select(F.col("path").alias("file_path"), F.col("text").alias("_upload_text"),
                             F.lit(True).alias("_upload_exists"))
    r = (requests.withColumn("route", route_source(F.col("content_source")))
         .withColumn("_cat_subject", F.lower(F.col("subject")))
         .withColumn("_cat_chapter", chapter_int(F.col("chapter"))))
    # Only the chapters and uploads that requests name cross the join's shuffle: the catalog and the
    # upload texts are first semi-joined to the distinct requested keys (a small set, which Spark's size
    # check broadcasts, so the filter runs before any shuffle of the texts).
    cat_keys = r.filter(F.col("route") == "chapter").select("_cat_subject", "_cat_chapter").distinct()
    up_keys = r.filter(F.col("route") == "upload").select("file_path").where(F.col("file_path").isNotNull()).distinct()
    cat = cat.join(cat_keys, ["_cat_subject", "_cat_chapter"], "left_semi")
    up = up.join(up_keys, "file_path", "left_semi")
    joined = (r.join(cat, ["_cat_subject", "_cat_chapter"], "left")
              .join(up, "file_path", "left"))
    fp = F.col("file_path")
    no_file = fp.isNull() | (fp == "")
    up_exists = F.coalesce(F.col("_upload_exists"), F.lit(False))
    up_pdf = F.lower(path_suffix(fp)) == R.PDF_SUFFIX
    route = F.col("route")
    status = (F.when(route == "camera", F.lit("camera"))
              .when((route == "upload") & (no_file | ~up_exists), F.lit("missing"))
              .when(route == "upload", F.when(~up_pdf, "unsupported")
                    .when(F.coalesce(F.col("_upload_text"), F.lit("")) == "", "unreadable").otherwise("ok"))
              .when(F.col("chapter_path").isNull(), F.lit("missing"))
              .when(F.coalesce(F.col("_chapter_text"), F.lit("")) == "", F.lit("unreadable"))
              .otherwise(F.lit("ok")))
    content = (F.when((status == "ok") & (route == "upload"), F.col("_upload_text"))
               .when((status == "ok") & (route == "chapter"), F.col("_chapter_text"))
               .otherwise(F.lit("")))
    detail = (F.when((route == "upload") & no_file, F.lit(R.NO_PDF_UPLOADED))
              .when((route == "upload") & ~up_exists, F.concat(F.lit(R.UPLOAD_NOT_FOUND_HEAD), fp))
              .when((route == "upload") & (status == "unsupported"),
                    F.concat(F.lit(R.UNSUPPORTED_HEAD), path_suffix(fp), F.lit(R.UNSUPPORTED_TAIL)))
              .when((route == "upload") & (status == "unreadable"), F.lit(R.UPLOAD_NO_TEXT))
              .when((route == "chapter") & (status == "missing"),
                    F.concat(F.lit(R.CHAPTER_NOT_FOUND_HEAD), F.lit("content/"), F.col("_cat_subject"),
                             F.lit("/chapter"), F.col("_cat_chapter").cast("string"), F.lit(".pdf"),
                             F.lit(" (subject="), F.coalesce(F.col("subject"), F.lit("None")),
                             F.lit(", chapter="), F.col("_cat_chapter").cast("string"), F.lit(")")))
              .when((route == "chapter") & (status == "unreadable"),
                    F.concat(F.lit(R.CHAPTER_NO_TEXT_HEAD), F.col("chapter_path"), F.lit(R.CHAPTER_NO_TEXT_TAIL))))
    return (joined.withColumn("status", status).withColumn("content", content)
            .withColumn("status_message", status_message(status, detail))
            .drop("_cat_subject", "_cat_chapter", "_chapter_text", "_upload_text", "_upload_exists"))


def status_message(status, detail) -> Column:
    """The student-facing reply for a content outcome (null when ok)."""
    s = col_of(status)
    return (F.when(s == "missing", F.concat(F.lit(R.NOT_FOUND_HEAD), col_of(detail)))
            .when(s.isin("unreadable", "unsupported"), F.concat(F.lit(R.UNREADABLE_HEAD), col_of(detail))))


def upload_reply(kind, text) -> Column:
    """T19 for the upload tool: unsupported type, no text, or null to go on."""
    k, t = col_of(kind), col_of(text)
    return (F.when(k == "unsupported", F.lit(R.UNSUPPORTED_UPLOAD_REPLY))
            .when(t.isNull() | (py_strip(t) == ""), F.lit(R.NO_TEXT_UPLOAD_REPLY)))
