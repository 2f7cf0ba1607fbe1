"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

Texts are kept in blocks of some million words. Each block sends its distinct
n-grams, as sorted 64-bit hashes cut into buckets of the hash space, to the
bucket's count table; the table sums them over all blocks and sends each block
the counts of its own n-grams back, where they are joined to the n-grams'
places and summed per document. So a frequent n-gram costs one entry per block,
the number of buckets follows the corpus, and no bucket or block outgrows a
task. The counts a document is scored with leave out its own occurrences.
Blocks are kept once, in the exchange that both the counting and the scoring
read; a block that was computed anew and differs stops the job.

S(w | h) = c(h w) / c(h) where c(h w) > 0, else ``backoff`` * S(w | h without
its first word); S(w) = c(w) / N where c(w) > 0, else 1 / (N + 1), N being all
words of other documents. N-grams stay inside a document; words are lower-cased
(A-Z) runs without ASCII white space.

Defined results: a null or empty text has no words, log-score 0 and no mean.
Repeated rows and doc_ids are documents of their own, so copies do count for
each other. Texts of any length are scored whole; a very long one makes a
larger block. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 3
BACKOFF = 0.4
#: Words of a block (a task's memory is about 50 bytes for each and order), n-grams of a bucket.
BLOCK_WORDS, BUCKET_GRAMS = 1_000_000, 2_000_000
REMEMBERED_WORDS = 200_000
#: Bytes a word takes at least, on the whole; it only sets the number of buckets.
WORD_BYTES = 4
#: Bucket of the blocks' own totals.
TOTALS = -1

_BLOCK = "block long, words long, doc_ids binary, sizes binary, vocabulary binary, ids binary"
_GRAM = "bucket int, block long, first binary, steps binary, own binary"
_GRAM_NAMES = [x.split()[0] for x in _GRAM.split(", ")]
_GRAM_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _squeeze(x: np.ndarray) -> bytes:
    """All lowest bytes, all second ones and so on, each compressed by themselves (the higher ones are mostly zero), after their sizes."""
    import zstandard
    one = zstandard.ZstdCompressor(level=1)
    planes = [one.compress(p.tobytes()) for p in np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T]
    return b"".join([np.array([len(p) for p in planes], "<u4").tobytes(), *planes])


def _expand(data: bytes, dtype: str) -> np.ndarray:
    import zstandard
    n, one = np.dtype(dtype).itemsize, zstandard.ZstdDecompressor()
    ends = 4 * n + np.cumsum(np.frombuffer(data[:4 * n], "<u4"), dtype=np.int64)
    planes = [np.frombuffer(one.decompress(data[s:e]), np.uint8) for s, e in zip([4 * n, *ends], ends)]
    return np.stack(planes, axis=1).view(dtype).ravel()


def _block_batches(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    block, docs, hashes, words = TaskContext.get().partitionId() << 32, [], [], 0

    def flush():
        # numbered by frequency, then hash: small numbers compress well, and so do the steps between words of one frequency
        vocabulary, ids, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        cols = [block, words, np.array([d is not None for d, _ in docs]).tobytes() + np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
                _squeeze(np.array([n for _, n in docs], "<u4")), _squeeze(np.diff(vocabulary[order], prepend=np.uint64(0))), _squeeze(rank[ids])]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in cols], names=[x.split()[0] for x in _BLOCK.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = (text.as_py() or b"").lower().split()
            hashes.append(np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found)))
            docs.append((doc_id, len(found)))
            words += len(found)
            if words >= block_words:
                yield flush()
                block, docs, hashes, words = block + 1, [], [], 0
    if docs:
        yield flush()


class _Block:
    """A block's n-grams of all orders: their distinct hashes, and where each occurrence's hash is among them."""

    def __init__(self, row: dict, order: int):
        self.block = row["block"]
        self.sizes = _expand(row["sizes"], "<u4").astype(np.int64)
        n = len(self.sizes)
        self.doc_ids = [i if known else None for known, i in zip(np.frombuffer(row["doc_ids"][:n], bool), np.frombuffer(row["doc_ids"][n:], "<i8").tolist())]
        self.doc = np.repeat(np.arange(n), self.sizes)
        first = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.place = np.arange(len(self.doc)) - first       # a word's place in its document
        word = np.cumsum(_expand(row["vocabulary"], "<u8"), dtype=np.uint64)[_expand(row["ids"], "<u4")]
        grams, h = [], None
        for k in range(order):
            # the hash of the last k+1 words; meaningless, and not used, where the document has fewer before
            h = word if h is None else np.concatenate([h[:1], h[:-1] * _MULTIPLIERS[0] + word[1:] * _MULTIPLIERS[1]])
            h = (h ^ (h >> np.uint64(29))) * _MULTIPLIERS[2]
            h = h ^ (h >> np.uint64(32))
            grams.append(h)
        self.used = [self.place >= k for k in range(order)]
        self.grams, at = np.unique(np.concatenate([g[u] for g, u in zip(grams, self.used)]), return_inverse=True)
        self.at = np.split(at, np.cumsum([u.sum() for u in self.used])[:-1])
        self.own = np.bincount(at, minlength=len(self.grams)).astype("<u4")
        self.checksum = crc32(self.own, crc32(self.grams))

    def edges(self, buckets: int) -> np.ndarray:
        """Where each bucket of the hash space begins among the sorted hashes."""
        starts = [(b << 64) // buckets for b in range(buckets)]
        return np.append(np.searchsorted(self.grams, np.array(starts, dtype=np.uint64)), len(self.grams))


def _gram_batches(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            b = _Block(row, order)
            edges = b.edges(buckets)
            out = [(i, b.block, *_pack(b.grams[s:e]), _squeeze(b.own[s:e])) for i, (s, e) in enumerate(zip(edges, edges[1:])) if e > s]
            out.append((TOTALS, b.block, b"", b"", np.array([row["words"], b.checksum], "<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _GRAM_TYPES)], names=_GRAM_NAMES)


def _pack(sorted_hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted hashes as the first one and the steps to the next."""
    return sorted_hashes[:1].tobytes(), _squeeze(np.diff(sorted_hashes))


def _unpack(first: bytes, steps: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(first, "<u8"), _expand(steps, "<u8")]), dtype=np.uint64)


def _count_bucket(table: pa.Table) -> pa.Table:
    """Corpus counts of one bucket's n-grams, for each block in the order of its own hashes; the corpus's words and the
    block's checksum of them in the bucket of totals."""
    rows = table.to_pylist()
    if rows[0]["bucket"] == TOTALS:
        own = np.array([np.frombuffer(r["own"], "<u8") for r in rows])
        parts = np.column_stack([np.full(len(own), own[:, 0].sum()), own[:, 1]])
    else:
        grams = [_unpack(r["first"], r["steps"]) for r in rows]
        distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(at, np.concatenate([_expand(r["own"], "<u4") for r in rows]), len(distinct)).astype("<u8")
        parts = np.split(total[at], np.cumsum([len(g) for g in grams])[:-1])
    return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                     "counts": pa.array([_squeeze(p) for p in parts], pa.binary())})


def _score_block(blocks: pa.Table, counted: pa.Table, order: int, backoff: float) -> pa.Table:
    changed = RuntimeError("a block was computed anew with other rows: the order of the input's rows changed")
    if not blocks.num_rows or not counted.num_rows:
        raise changed
    out = []
    for row in blocks.to_pylist():
        b = _Block(row, order)
        parts = [_expand(c, "<u8") for _, c in sorted((r["bucket"], r["counts"]) for r in counted.to_pylist())]
        (corpus_words, checksum), total = parts[0].tolist(), np.concatenate([np.zeros(0, "<u8"), *parts[1:]])
        if checksum != b.checksum:
            raise changed
        n = len(b.doc)
        counts = np.zeros((order, n))                       # of the n-gram that ends at each word, without the document's own
        for k, (used, at) in enumerate(zip(b.used, b.at)):
            _, mine, times = np.unique(b.doc[used] * len(b.grams) + at, return_inverse=True, return_counts=True)
            counts[k, used] = total[at].astype(np.float64) - times[mine]
        others = corpus_words - b.sizes[b.doc].astype(np.float64)
        score = np.where(counts[0] > 0, counts[0] / np.maximum(others, 1), 1 / (others + 1))
        for k in range(1, order):
            history = np.concatenate([[0.0], counts[k - 1, :-1]])
            seen = counts[k] > 0
            deeper = np.where(seen, counts[k] / np.where(seen, history, 1), backoff * score)
            score = np.where(b.used[k], deeper, score)
        logs = np.bincount(b.doc, np.log(score), len(b.sizes))
        out.append(pa.table({"doc_id": pa.array(b.doc_ids, pa.int64()), "words": pa.array(b.sizes), "log_score": pa.array(logs, pa.float64())}))
    return pa.concat_tables(out)


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_words: int = BLOCK_WORDS,
          bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """``doc_id, words, log_score`` for every row (natural logarithms, summed over the words)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-order * size // (WORD_BYTES * bucket_grams)))
    blocks = texts.mapInArrow(lambda it: _block_batches(it, block_words), _BLOCK).repartition("block")
    grams = blocks.mapInArrow(lambda it: _gram_batches(it, order, buckets), _GRAM)
    counted = grams.groupBy("bucket").applyInArrow(_count_bucket, "block long, bucket int, counts binary")
    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        lambda left, right: _score_block(left, right, order, backoff), "doc_id long, words long, log_score double")
