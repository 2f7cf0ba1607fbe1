"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius, grouped by reachability.

Only distinct fingerprints are linked, so copies cost one row each; the links
are found by multi-index hashing (see :mod:`chalkline.llm.links`).

Defined results: a null text counts as empty; texts without words have
fingerprint zero and are linked like any other; texts with fewer words than a
shingle have their whole word sequence as the one shingle. Whole texts are
read, whatever their length. Rows that repeat a doc_id are one document, which
may have several fingerprints; :func:`keep_first` judges each row by itself and
keeps one row of a component, also where its rows share an id or have none. A
null doc_id comes after all others: it is a component's id only where no other
is. An empty table gives no rows; extra columns are ignored (or kept, by
:func:`keep_first`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import fresh, materialize
from chalkline.llm.links import components, hamming_links
from chalkline.llm.shards import row_versions

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set where over half of the shingles' XXH64 values have it (as a signed 64-bit integer)."""
    from xxhash import xxh64_intdigest
    found = (text or b"").lower().split()                   # bytes: A-Z and the six ASCII separators only
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    at = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    start = np.concatenate([[0], at[:n - 1]]).tolist()
    end = (at[-n:] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        j = min(n, i + CHUNK)
        h = np.fromiter(map(xxh64_intdigest, [joined[a:b] for a, b in zip(start[i:j], end[i:j])], repeat(SEED)), "<u8", j - i)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(t.as_py(), words) for t in batch.column("text")]
        ids = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(fps, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, version: str | None = None) -> DataFrame:
    """``doc_id, fp`` for every row, with its version (see :func:`chalkline.llm.shards.row_versions`) as ``v`` if that is named."""
    ids = [F.col("doc_id").cast("long").alias("doc_id"), *([F.col(version).alias("v")] if version else [])]
    return docs.select(*ids, F.col("text").cast("binary").alias("text")).mapInArrow(
        lambda it: _fingerprint_batches(it, words), f"doc_id long, {'v long, ' if version else ''}fp long")


def _rooted(members: DataFrame, radius: int) -> DataFrame:
    """``fp, first, root`` of every fingerprint: its smallest doc_id and the fingerprint that stands for its component."""
    classes = materialize(members.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(hamming_links(classes.select("fp"), radius))
    return materialize(classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest doc_id reachable over links of at most ``radius`` bits."""
    members = materialize(fingerprints(docs, words))
    rooted = _rooted(members, radius)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(smallest, "root").select(F.col("fp").alias("class"), "component_id")
    # a hot class is split by adaptive execution: its documents only stream past one class row
    return members.join(ids, F.col("fp") == F.col("class")).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id (null last), then of the smallest version."""
    own, kept_id, kept_row = (fresh(docs, c) for c in ("row", "first", "version"))
    rows = row_versions(docs, own)
    members = materialize(fingerprints(rows, words, own))
    # fingerprints first, so that a hot one reaches its component as one row
    firsts = members.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "v")).alias("row"))
    roots = _rooted(members, radius).select(F.col("fp").alias("class"), "root")
    kept = firsts.join(roots, F.col("fp") == F.col("class")).groupBy("root").agg(F.min("row").alias("row"))
    kept = kept.select(F.col("row.doc_id").alias(kept_id), F.col("row.v").alias(kept_row))
    return rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_row)), "left_semi").drop(own)
