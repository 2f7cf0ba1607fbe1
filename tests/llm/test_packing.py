import zlib

import numpy as np
from pyspark.sql import functions as F

from chalkline.llm import packing
from chalkline.llm.common import tokenizer_file


def ids_of(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_file(packing.VOCABULARY))
    tok.encode_special_tokens = True
    return [tok.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]


def check(rows, texts, size):
    """Every id in exactly one piece, windows gapless and full but the last."""
    at, pieces = 0, []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * size + r.offset == at
        at += r.length
        pieces.append(np.frombuffer(r.ids, "<u4").tolist())
        assert len(pieces[-1]) == r.length and r.offset + r.length <= size
    stream = [i for p in pieces for i in p]
    found = "".join(map(chr, stream)).split(chr(packing.END_ID))[:-1]
    want = ["".join(map(chr, x[:-1])) for x in ids_of(texts)]
    assert sorted(found) == sorted(want)


def test_matches_whole_text_tokenization(spark, messy):
    rows = packing.pack(messy, 64).collect()
    texts = [r.text for r in messy.select("text").collect()]
    check(rows, texts, 64)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc in (1, 8, 9, 12):
        own = ids_of([messy.filter(F.col("doc_id") == doc).first().text])[0]
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        assert [i for r in parts for i in np.frombuffer(r.ids, "<u4").tolist()] == own
        assert all(r.doc_tokens == len(own) for r in parts)


def test_generated_documents_over_partitions(spark, sample):
    rows = packing.pack(sample.repartition(5)).collect()
    texts = [r.text for r in sample.select("text").collect()]
    check(rows, texts, packing.SEQUENCE_TOKENS)


def test_crc_and_sequences(spark, sample):
    pieces = packing.pack(sample.limit(20), 128)
    pieces = spark.createDataFrame(pieces.collect(), pieces.schema)
    for r in pieces.select("ids", F.crc32("ids").alias("c")).collect():
        assert r.c == zlib.crc32(r.ids)
    seqs = {r.sequence_id: r for r in packing.sequences(pieces, 128).collect()}
    assert sum(r.used for r in seqs.values()) == sum(r.length for r in pieces.collect())
    last = seqs.pop(max(seqs))
    assert all(r.used == 128 and len(r.ids) == 512 for r in seqs.values())
    assert len(last.ids) == 4 * (last.used if last.used & (last.used - 1) == 0 else 128)


def test_empty(spark, empty_docs):
    assert packing.pack(empty_docs).count() == 0
