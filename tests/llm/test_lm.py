import math
from collections import Counter

import pytest

from chalkline.llm import lm


def brute(rows, order, backoff):
    docs = [(text or "").encode().lower().split() for _, text in rows]
    grams = [Counter(tuple(d[i - k:i + 1]) for i in range(len(d)) for k in range(min(i + 1, order))) for d in docs]
    total, words = sum(grams, Counter()), sum(map(len, docs))
    out = []
    for (doc_id, _), d, own in zip(rows, docs, grams):
        def c(g):
            return total[g] - own[g]

        def s(g):
            if len(g) == 1:
                n = words - len(d)
                return c(g) / n if c(g) else 1 / (n + 1)
            return c(g) / c(g[:-1]) if c(g) else backoff * s(g[1:])
        out.append((doc_id, len(d), sum(math.log(s(tuple(d[max(0, i - order + 1):i + 1]))) for i in range(len(d)))))
    return out


@pytest.mark.parametrize("order,block_words,bucket_grams", [(2, 500, 300), (3, 10_000, 2_000), (1, 100_000, 1_000_000)])
def test_matches_brute_force(spark, messy, sample, order, block_words, bucket_grams):
    docs = sample.limit(40).select("doc_id", "text").unionByName(messy.filter("doc_id is null or doc_id <> 10").select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), order, 0.4, block_words, bucket_grams).collect()

    def shown(found):
        return sorted((str(d), n, round(s, 6)) for d, n, s in found)
    assert shown(map(tuple, got)) == shown(brute(rows, order, 0.4))


def test_packed_hashes():
    import numpy as np
    for x in ([5], [0, 1, 2], [3, 1 << 63, (1 << 64) - 1]):
        x = np.array(x, dtype=np.uint64)
        assert (lm._unpack(*lm._pack(x)) == x).all()


def test_squeezed_numbers():
    import numpy as np
    for dtype in ("<u4", "<u8"):
        for x in ([], [7], [0, 1, 255, 256, (1 << 32) - 1]):
            x = np.array(x, dtype=dtype)
            assert (lm._expand(lm._squeeze(x), dtype) == x).all() and len(lm._expand(lm._squeeze(x), dtype)) == len(x)


def test_empty_and_long(spark, empty_docs, messy):
    assert lm.score(empty_docs).count() == 0
    rows = {r.doc_id: r for r in lm.score(messy).collect() if r.doc_id in (2, 3, 10)}
    assert rows[2].words == rows[3].words == 0 and rows[2].log_score == 0
    assert rows[10].words == 30_000


def test_blocks_lie_in_one_exchange(spark, sample):
    """The counting and the scoring read the same stored blocks, which are not written a second time."""
    out = lm.score(sample.select("doc_id", "text"), 3, 0.4, 20_000, 50_000)
    checkpoints = out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert checkpoints == 0 and plan.count("ReusedExchange") == 1


def test_a_block_with_other_rows_is_refused():
    import numpy as np
    import pyarrow as pa
    from types import SimpleNamespace
    from unittest.mock import patch
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"a b c", b"a b d"])], names=["doc_id", "text"])
    with patch("pyspark.TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))):
        block, = lm._block_batches(iter([batch]), 100)
        other, = lm._block_batches(iter([batch.take(pa.array([1, 0]))]), 100)
        short, = lm._block_batches(iter([batch.slice(1)]), 100)
    grams, = lm._gram_batches(iter([block]), 2, 1)
    grams = pa.Table.from_batches([grams])
    is_total = np.array(grams["bucket"].to_pylist()) == lm.TOTALS
    counted = pa.concat_tables([lm._count_bucket(grams.filter(pa.array(~is_total))), lm._count_bucket(grams.filter(pa.array(is_total)))])
    for right in (block, other):
        assert lm._score_block(pa.Table.from_batches([right]), counted, 2, 0.4)["words"].to_pylist() == [3, 3]
    for left, right in ((short, counted), (block.slice(1), counted), (block, counted.slice(2))):
        with pytest.raises(RuntimeError, match="other rows"):
            lm._score_block(pa.Table.from_batches([left]), right, 2, 0.4)
