"""WARC archives: records written with revisits of equal payloads, and read back by verified boundary chains.

Writing: a page is one record, an HTTP response around its html. Of the pages
with equal payloads of at least ``LEAST_SHARED`` bytes the one with the
smallest page_id is written as ``response``; the others are ``revisit`` records
without payload that refer to it. Which is which comes from narrow rows
(digest, page_id) alone; the payloads stay in their partition, but for those
with copies where there are too many to name them to all tasks.

Reading: the archives are cut at every occurrence of the magic ``WARC/1.``, by
Spark's splittable text source, wherever the splits fall. Each task emits its
pieces as candidate records: the offset of the magic, and that of the
successor that the header's Content-Length names. Inside a split the chains are
followed at once; then pointer jumping from offset 0 of each file, over one
short row per place where a chain enters a split, finds in a logarithmic number
of rounds the entries that can be reached. Only records on such a chain are
returned, so a magic inside a payload, or a whole forged record there, is none.
A record whose payload holds the magic is put together from its pieces.

Defined results: a null html is an empty payload; a null page_id comes after
all others, so it is a response only where no other row has its payload (then
revisits refer to null). Rows that repeat page_id and payload are records of
their own, one of them the response. A null url gives a record without target;
line ends in a url are percent-encoded. A file that does not begin with a
record has none; a chain that breaks (no record where one ends, a record cut
off by the end of the file) ends the file's records there. An empty table gives
archives without records. Payloads of any length are read whole; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chalkline.llm.common import materialize

MAGIC = "WARC/1."
LEAST_SHARED = 100
#: Digests of at most this many rows (under 150 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of a file that meet in one place when records with a magic inside are put together.
STRIPE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _GAP = b"\r\n", b"\r\n\r\n"


# ---- writing

def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, size`` of every page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"),
                        F.octet_length(html).cast("long").alias("size"))


def first_captures(rows: DataFrame) -> DataFrame:
    """``shared, first, again``: the digests that several rows have, with their smallest page_id and how many rows have both."""
    classes = (rows.filter(F.col("size") >= LEAST_SHARED).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("digest").agg(F.sum("n").alias("rows"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")).alias("f")))
    return classes.filter("rows > 1").select(F.col("digest").alias("shared"), F.col("f.page_id").alias("first"), F.col("f.n").alias("again"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_roles(rows: DataFrame) -> DataFrame:
    """``rows`` with ``shared`` (null where no other row has the payload), ``first`` and ``revisit``."""
    known = materialize(first_captures(rows))
    marked = rows.join(_small(known), rows["digest"] == known["shared"], "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    twice = F.col("again").isNotNull() & (F.col("again") > 1) & is_first
    alone = marked.filter(~twice).withColumn("revisit", F.col("shared").isNotNull() & ~is_first)
    if known.filter("again > 1").isEmpty():
        return alone.drop("again")
    # rows equal in page_id and payload: stored once, so that a number tells them apart
    numbered = materialize(marked.filter(twice).withColumn("row", F.monotonically_increasing_id()))
    least = numbered.groupBy(F.col("shared").alias("of")).agg(F.min("row").alias("least"))
    repeats = numbered.join(least, F.col("shared") == F.col("of")).withColumn("revisit", F.col("row") != F.col("least"))
    return alone.drop("again").unionByName(repeats.drop("again", "row", "of", "least"))


def _urn(of: Column) -> Column:
    """A record id made from a hash, in the form of a uuid."""
    h = F.sha2(of, 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``record``: every page's whole record but for the last line end."""
    rows = with_roles(captures(pages))
    response = _urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("first").cast("string"), F.lit("none")), "shared"))
    own = F.when(F.col("shared").isNotNull() & ~F.col("revisit"), response).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    revisit = F.col("revisit")
    head = F.concat_ws(
        "\r\n", F.lit(MAGIC + "1"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", own), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, field("WARC-Refers-To", response)), F.when(revisit, field("WARC-Profile", F.lit(PROFILE))),
        field("Content-Type", F.lit("application/http; msgtype=response")), field("X-Page-Id", F.col("page_id").cast("string")),
        field("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")))
    return rows.select(F.concat(head, F.lit("\r\n\r\n"), http, F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n")).alias("record"))


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """One archive per partition of ``pages``, in the folder ``path`` of any store that Spark writes."""
    records(pages, date).write.option("lineSep", "\r\n").text(path)


# ---- reading

_PIECE = ("file string, block long, at long, length long, size long, whole boolean, record_type string, record_id string, "
          "refers_to string, page_id long, target_uri string, declared string, payload_bytes long, payload_digest string")
_FIELDS = [("record_type", b"warc-type"), ("record_id", b"warc-record-id"), ("refers_to", b"warc-refers-to"),
           ("page_id", b"x-page-id"), ("target_uri", b"warc-target-uri"), ("declared", b"warc-payload-digest")]


def parse(piece: bytes) -> dict | None:
    """Header fields and sizes of a candidate record that begins with ``piece`` (behind the magic); None if it is none.

    ``size`` counts from the magic to the successor; payload fields are given where the piece holds the whole record.
    """
    end = piece.find(_GAP)
    lines = piece[:end].split(_END) if end >= 0 else [b""]
    if not lines[0].isdigit():
        return None
    head = {name.strip().lower(): value.strip() for name, colon, value in (x.partition(b":") for x in lines[1:]) if colon}
    length = head.get(b"content-length", b"")
    if not (length.isdigit() and len(length) < 19 and b"warc-type" in head):
        return None
    start, stop = end + len(_GAP), end + len(_GAP) + int(length)
    out = {name: head[key].decode("utf-8", "replace") if key in head else None for name, key in _FIELDS}
    number = out["page_id"] or ""
    out["page_id"] = int(number) if number.removeprefix("-").isdecimal() else None
    out |= {"size": len(MAGIC) + stop + len(_GAP), "whole": len(piece) >= stop}
    if out["whole"]:
        body = start
        if head.get(b"content-type", b"").startswith(b"application/http"):
            gap = piece.find(_GAP, start, stop)
            body = stop if gap < 0 else gap + len(_GAP)
        payload = memoryview(piece)[body:stop]
        out |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    return out


def _scan(batches: Iterator[pa.RecordBatch], content: bool) -> Iterator[pa.RecordBatch]:
    """Pieces with their place in the split (rows of a split come in its order), parsed, or (``content``) as they are."""
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t])
                        for n, t in (x.split() for x in _PIECE.split(", "))])
    if content:
        schema = pa.schema([*list(schema)[:4], ("value", pa.binary())])
    split, at = None, 0
    for batch in batches:
        rows = []
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if split != (file, block):
                split, at = (file, block), 0
            piece = value.as_py() or b""
            row = {"file": file, "block": block, "at": at, "length": len(piece)}
            rows.append(row | ({"value": piece} if content else parse(piece) or {}))
            at += len(piece) + len(MAGIC)
        yield pa.RecordBatch.from_pylist(rows, schema)


def pieces(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """What lies between two magics, for all archives in ``path``."""
    found = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("value").cast("binary"))
    schema = ", ".join(_PIECE.split(", ")[:4]) + ", value binary" if content else _PIECE
    return found.mapInArrow(partial(_scan, content=content), schema)


def placed(found: DataFrame) -> DataFrame:
    """Pieces with ``offset``, that of their magic in the file, and ``file_end``; what precedes a file's first magic goes.

    The splits of a file tile it, so a split begins where the bytes of those before it end: one row per split is summed up.
    """
    step = F.col("length") + len(MAGIC)
    totals = found.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    of_file = Window.partitionBy("file")
    bases = totals.select(F.col("file").alias("f"), F.col("block").alias("b"), (F.sum("bytes").over(of_file) - len(MAGIC)).alias("file_end"),
                          F.coalesce(F.sum("bytes").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = found.join(bases, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return out.withColumn("offset", F.col("base") + F.col("at") - len(MAGIC)).filter("offset >= 0").drop("f", "b", "base", "at")


def _links(offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For the candidates of one split, in order: index of the next one, -1 (none there), or -2 (beyond the last candidate)."""
    following = offset + size
    at = np.minimum(np.searchsorted(offset, following), len(offset) - 1)
    return np.where(size == 0, -1, np.where(following > offset[-1], -2, np.where(offset[at] == following, at, -1)))


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.sort_by("offset")
    return table, np.asarray(table["offset"], dtype=np.int64), np.asarray(table["size"].fill_null(0), dtype=np.int64)


def _exits(key: tuple, table: pa.Table) -> pa.Table:
    """Where the chain of each candidate leaves the split; -1 where it breaks before."""
    table, offset, size = _sorted(table)
    exits = np.full(len(offset), -1)
    links = _links(offset, size).tolist()
    for i in range(len(links) - 1, -1, -1):
        exits[i] = offset[i] + size[i] if links[i] == -2 else exits[links[i]] if links[i] >= 0 else -1
    on = size > 0
    return pa.table({"file": pa.array([key[0].as_py()] * int(on.sum()), pa.string()), "block": pa.array([key[1].as_py()] * int(on.sum()), pa.int64()),
                     "offset": offset[on], "leaves": exits[on]})


def _follow(key: tuple, table: pa.Table) -> pa.Table:
    """The rows on the chain from the split's entry."""
    table, offset, size = _sorted(table)
    links = _links(offset, size)
    at, on = int(np.searchsorted(offset, table["entry"][0].as_py())), []
    while at >= 0 and size[at]:
        on.append(at)
        at = int(links[at])
    return table.take(pa.array(on, pa.int64())).drop_columns(["entry"])


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (file, block, offset, size, ...) that a chain of records from offset 0 of their file reaches."""
    exits = materialize(candidates.select("file", "block", "offset", "size").groupBy("file", "block").applyInArrow(
        _exits, "file string, block long, offset long, leaves long"))
    # only where some chain leaves off, or a file begins, can a chain go on: about one row for each split
    doors = exits.filter("leaves >= 0").select("file", F.col("leaves").alias("offset")).distinct()
    starts = exits.filter("offset = 0").select("file", "offset")
    links = materialize(exits.join(doors.unionByName(starts).distinct(), ["file", "offset"], "left_semi"))
    reached = materialize(starts)
    jumps = links.select("file", "offset", "leaves")
    while True:
        # after k rounds ``reached`` holds the entries up to 2^k - 1 jumps away and ``jumps`` leads 2^k further
        onward = reached.join(jumps, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
        onward = onward.join(links, ["file", "offset"], "left_semi")
        more = materialize(onward.join(reached, ["file", "offset"], "left_anti"))
        if more.isEmpty():
            break
        reached = materialize(reached.unionByName(more))
        to = jumps.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("then"))
        jumps = materialize(jumps.join(to, ["file", "leaves"]).select("file", "offset", F.col("then").alias("leaves")))
    entries = reached.join(links, ["file", "offset"]).select("file", "block", F.col("offset").alias("entry"))
    return candidates.join(entries, ["file", "block"]).groupBy("file", "block").applyInArrow(_follow, candidates.schema)


def _put_together(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("offset")
    values = [x.as_py() for x in table["value"]]
    found = parse(MAGIC.encode().join(values)) or {}
    return pa.table({"file": pa.array([key[0].as_py()], pa.string()), "start": pa.array([key[1].as_py()], pa.int64()),
                     "bytes": pa.array([found.get("payload_bytes")], pa.int64()), "digest": pa.array([found.get("payload_digest")], pa.string())})


def _mended(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """``file, start, bytes, digest`` of the records ``broken`` (file, offset, size) whose payload holds the magic."""
    files = broken.select(F.col("file").alias("in_file")).distinct()
    raw = pieces(spark, path, content=True)
    parts = placed(materialize(raw.join(files, raw["file"] == F.col("in_file"), "left_semi")))
    last = F.col("offset") + F.col("size") - 1
    spans = broken.select(F.col("file").alias("of"), F.col("offset").alias("start"), last.alias("last"),
                          F.explode(F.sequence(F.floor(F.col("offset") / STRIPE), F.floor(last / STRIPE))).alias("stripe"))
    parts = parts.withColumn("own_stripe", F.floor(F.col("offset") / STRIPE))
    met = parts.join(spans, (F.col("file") == F.col("of")) & (F.col("own_stripe") == F.col("stripe")) & F.col("offset").between(F.col("start"), F.col("last")))
    return met.select("file", "start", "offset", "value").groupBy("file", "start").applyInArrow(
        _put_together, "file string, start long, bytes long, digest string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, size, record_type, record_id, refers_to, page_id, target_uri, declared, payload_bytes,
    payload_digest`` of every record of the archives in ``path``; ``refers_to`` is a record_id."""
    found = placed(materialize(pieces(spark, path)))
    kept = reachable(found.drop("length")).filter(F.col("offset") + F.col("size") <= F.col("file_end"))
    kept = materialize(kept.drop("file_end"))
    broken = kept.filter(~F.col("whole"))
    if not broken.isEmpty():
        mended = _mended(spark, path, broken.select("file", "offset", "size"))
        kept = kept.join(mended.withColumnRenamed("start", "offset"), ["file", "offset"], "left").withColumns({
            "payload_bytes": F.coalesce("payload_bytes", "bytes"), "payload_digest": F.coalesce("payload_digest", "digest")})
    return kept.select("file", "offset", "size", "record_type", "record_id", "refers_to", "page_id", "target_uri",
                       "declared", "payload_bytes", "payload_digest")


def resolved(found: DataFrame) -> DataFrame:
    """Records with the payload's size and digest also for revisits, whose ``refers_to`` becomes the page_id of the
    response; ``intact`` says that the payload has the digest its header declares."""
    response = found.filter("record_type = 'response'").select(
        F.col("record_id").alias("id"), F.col("page_id").alias("to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    revisits = found.filter("record_type = 'revisit'")
    named = response.join(revisits.select(F.col("refers_to").alias("id")).distinct(), "id", "left_semi")
    declared = F.concat(F.lit("sha256:"), F.col("payload_digest")).eqNullSafe(F.col("declared"))
    theirs = revisits.join(named, F.col("refers_to") == F.col("id"), "left").select(
        "page_id", "target_uri", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        F.col("to").alias("refers_to"), "declared")
    own = found.filter("record_type <> 'revisit'").select(
        "page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "declared")
    return own.unionByName(theirs).withColumn("intact", declared).drop("declared")
