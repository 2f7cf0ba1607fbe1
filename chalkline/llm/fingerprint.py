"""Document fingerprints: SimHash of weighted terms, and the search for all fingerprints within a radius.

A term is two neighbouring words (A-Z lower-cased); its weight is one more
than the whole binary logarithm of its count, so that a repeated line does not
decide the fingerprint alone. Every term's hash votes with its weight on 64
signed bits.

The search keeps tables of block permutations: of B blocks, two fingerprints
within r bits agree on B - r, so each choice of B - r leading blocks is one
table, looked up by their value; the complete distance is verified.

Defined results: a null text is empty; a text without words has fingerprint
zero; one word is its own term. Documents follow each other by doc_id (nulls
first), rows of equal doc_id by their text's hash; the last is followed by the
first. Repeated rows are documents of their own. Whole texts are read,
whatever their length. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import materialize
from chalkline.llm.links import distance, segments

RADIUS, BLOCKS = 3, 6
#: Word hashes that each Python worker remembers.
REMEMBERED_WORDS = 200_000
#: Terms that vote at a time.
CHUNK = 1 << 16

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def simhash(text: str) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) > 1:
        h = h[:-1] * _MULTIPLIERS[0] + h[1:] * _MULTIPLIERS[1]
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[2]
    terms, counts = np.unique(h ^ (h >> np.uint64(29)), return_counts=True)
    weights = np.frexp(counts)[1].astype(np.float32)        # 1 + floor(log2(count))
    votes = np.zeros(64)
    for i in range(0, len(terms), CHUNK):
        bits = np.unpackbits(terms[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[i:i + CHUNK] @ (bits.astype(np.float32) * 2 - 1)
    return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0])


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


_DONE, _LAST, _FIRST = 0, 1, 2
_PAIRED = ("part long, kind int, doc_id long, text string, n_chars long, edited_sha256 string, "
           "fp long, edited_fp long, next_fp long")
_PAIRED_NAMES = [x.split()[0] for x in _PAIRED.split(", ")]
_PAIRED_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in _PAIRED.split(", ")]


def _record(part, doc_id, text, fp, following, next_fp):
    new = edited(text, following)
    return (part, _DONE, doc_id, None, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
            fp, fp if new == text else simhash(new), next_fp)


def _batch(records: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records), _PAIRED_TYPES)], names=_PAIRED_NAMES)


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the next of its partition; the partition's first and last text go out for the neighbours."""
    from pyspark import TaskContext
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            fp = simhash(text)
            if held is None:
                out.append((part, _FIRST, doc_id, text, None, None, fp, None, None))
            else:
                out.append(_record(part, *held, text, fp))
            held = (doc_id, text, fp)
        if out:
            yield _batch(out)
    if held is not None:
        yield _batch([(part, _LAST, held[0], held[1], None, None, held[2], None, None)])


def _finish_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        if rows:
            yield _batch([_record(r["part"], r["doc_id"], r["text"], r["fp"], r["next_text"], r["next_fp"]) for r in rows])


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp`` for every row.

    One range shuffle puts neighbours together; where a partition ends, its
    last document meets the next partition's first, two texts per partition.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = ordered.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    paired = materialize(ordered.mapInArrow(_pair_batches, _PAIRED))
    first = paired.filter(F.col("kind") == _FIRST)
    order = Window.orderBy("part")                          # one row for each partition
    parts = first.select("part").select("part", F.lead("part").over(order).alias("then"), F.min("part").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("start"))
    parts = parts.select("part", F.coalesce("then", "start").alias("then"))
    ends = (paired.filter(F.col("kind") == _LAST).select("part", "doc_id", "text", "fp").join(parts, "part")
            .join(first.select(F.col("part").alias("then"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp")), "then"))
    return (paired.filter(F.col("kind") == _DONE).unionByName(ends.mapInArrow(_finish_batches, _PAIRED))
            .drop("part", "kind", "text"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - distance(a, b) / F.lit(64.0)


def within_radius(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``a, b, bits`` (a < b): all pairs of the distinct longs ``fp`` at most ``radius`` bits apart, each once.

    A pair is emitted only by the first table in which its blocks agree.
    """
    parts = segments(blocks)
    tables = list(combinations(range(blocks), blocks - radius))
    masks = [sum(((1 << parts[i][1]) - 1) << parts[i][0] for i in t) for t in tables]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("table", "mask"))
    keyed = keyed.select("fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    other = keyed.select(F.col("fp").alias("b"), "table", "key")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(signed))):
        first = F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, i).otherwise(first)
    return (keyed.withColumnRenamed("fp", "a").join(other, ["table", "key"])
            .filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & (F.col("table") == first))
            .select("a", "b", F.bit_count(differ).alias("bits")))


def neighbour_counts(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, near``: how many other distinct fingerprints each one that has any finds within the radius."""
    pairs = within_radius(fps.select("fp").distinct(), radius)
    return (pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("near")))
