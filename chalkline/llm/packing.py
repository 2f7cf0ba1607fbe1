"""Packing: concatenate all documents and cut the stream into fixed windows.

Pass 1 turns every text into token ids (a public vocabulary, never trained
here) and numbers each document's first token inside its input partition.
The partition totals' prefix sums give every partition its place in the
global stream; pass 2 adds that place and cuts each document at the window
edges. A document that crosses an edge leaves one record for each window it
touches, so no window is ever gathered to build its pieces.

Defined results: a null or empty text has only its end mark; repeated rows
and repeated doc_ids are separate documents of the stream; a null doc_id is
kept as null; an empty table gives no pieces; extra columns are ignored. Very
long texts are cut like any other. The stream follows the order of the input
partitions, fixed by the checkpointed token table.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import materialize, prefix_sums, tokenizer_file

SEQUENCE_TOKENS = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words, and pieces of words, whose ids each Python worker remembers before it starts anew.
REMEMBERED = 300_000

_ENCODERS: dict = {}

#: The vocabulary's splitter over a plain alphabet (ASCII and Latin-1 letters), where every character has one form.
_PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


#: Byte-level vocabularies write printable bytes as themselves, the others as the characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTED))}


class _Remembered(dict):
    """Unit of text -> its ids as little-endian uint16 (uint32 for large vocabularies)."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, unit: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[unit] = self.ids(unit)
        return found


class _Encoder:
    """Ids of whole texts, from ids of their parts.

    The vocabulary never joins text across white space or across the splits
    of its pre-tokenizer. A text is cut at ASCII separators (any other white
    space is left to the vocabulary's own splitter). Words of plain texts are
    split here and each distinct piece goes to the vocabulary's model once;
    words of other texts go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        self.dtype = "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
        code, model = "H" if self.dtype == "<u2" else "I", tok.model

        def piece_ids(piece: str) -> bytes:
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            return array(code, [t.id for t in model.tokenize(piece)]).tobytes()

        pieces = _Remembered(piece_ids)
        self.plain = _Remembered(lambda w: b"".join(map(pieces.__getitem__, _PIECES.findall(w.lower()))))
        self.other = _Remembered(lambda w: array(code, tok.encode(w, add_special_tokens=False).ids).tobytes())

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = self.plain if _PLAIN.fullmatch(text) else self.other
        return b"".join(map(words.__getitem__, text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")))


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


_TOKENS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("local_start", pa.int64()),
                            ("tokens", pa.int64()), ("ids", pa.binary())])


def _token_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part, encoder, at = TaskContext.get().partitionId(), _encoder(path), 0
    end = np.array([end_id], dtype=encoder.dtype).tobytes()
    width = len(end)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ids = [encoder(t) + end for t in texts]
        n = np.array([len(x) // width for x in ids], dtype=np.int64)
        start = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(n), part)), pa.array(start), pa.array(n), pa.array(ids, pa.binary())],
            schema=_TOKENS_SCHEMA)


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, local_start, tokens, ids``: ids with the end mark, in a compact binary form,
    and where the document starts in its input partition's own stream."""
    path = tokenizer_path or tokenizer_file(VOCABULARY)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda it: _token_batches(it, path, end_id),
        "doc_id long, part long, local_start long, tokens long, ids binary")


_PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                           ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _piece_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, first, n = (batch.column(i).to_pylist() for i in range(3))
        cols: list[list] = [[] for _ in _PIECE_SCHEMA]
        for d, g, tokens, raw in zip(doc, first, n, batch.column(3)):
            raw = raw.as_buffer()
            ids = np.frombuffer(raw, dtype=f"<u{raw.size // tokens}").astype("<u4").tobytes()
            start = 0
            while start < tokens:
                length = min(tokens - start, size - (g + start) % size)
                for c, v in zip(cols, (d, start, length, tokens, (g + start) // size, (g + start) % size,
                                       ids[4 * start:4 * (start + length)])):
                    c.append(v)
                start += length
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PIECE_SCHEMA)], schema=_PIECE_SCHEMA)


def pack(docs: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, tokenizer_path: str | None = None,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit token ids. All windows but the
    last are full, so padding is less than one window for the whole corpus.
    """
    tokens = materialize(tokenize(docs, tokenizer_path, end_id))
    totals = tokens.groupBy("part").agg(F.sum("tokens").alias("total"))
    places = prefix_sums(totals, "part", "total", "place")
    placed = (tokens.join(F.broadcast(places), "part")      # one short row for each input partition
              .select("doc_id", (F.col("place") + F.col("local_start")).alias("first"), "tokens", "ids"))
    return placed.mapInArrow(lambda it: _piece_batches(it, sequence_tokens),
                             "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, sequence_tokens: int = SEQUENCE_TOKENS, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, used``: each window's ids as one binary value, padded to ``sequence_tokens``
    unless its length is a power of two. At most ``sequence_tokens`` ids meet in a group."""
    joined = (pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
              .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")))
    used = (F.octet_length("ids") / 4).cast("int")
    missing = F.when(used.bitwiseAND(used - 1) == 0, 0).otherwise(F.lit(sequence_tokens) - used)
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), missing))
    return joined.select("sequence_id", F.concat("ids", pad).alias("ids"), used.alias("used"))
