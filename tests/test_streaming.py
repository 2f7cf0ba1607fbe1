"""Batch equals stream (ST1, ST2, ST3), fed as one file and as many files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from chalkline.functions.questions import coerce_path
from chalkline.operators import asof, cache, sessions
from chalkline.operators.documents import admit_upload
from chalkline.functions.rules import SOURCE_CAMERA
from chalkline.plans import inputs as I
from chalkline.plans import queries as Q
from chalkline.plans.salt import EVENT_ID_MULT
from chalkline.streaming.cache import COMPACT_EVERY, MissingDelta, index_state, process_batch, stream_cache
from chalkline.streaming.sessions import route_batch, stream_current_document, stream_route_intent, turn_state
from chalkline.sources.store import Store
from chalkline.streaming.state import KeyedState
from tests.conftest import SF001


def _write_files(df, path, split_col, n_files):
    """Write ``df`` as ``n_files`` parquet files, one per ``split_col`` group in order."""
    os.makedirs(path, exist_ok=True)
    if n_files == 1:
        df.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "part0"))
        return
    values = sorted(r[0] for r in df.select(split_col).distinct().collect())
    for i, v in enumerate(values):
        df.filter(F.col(split_col) == v).coalesce(1).write.parquet(os.path.join(path, f"part{i:03d}"))


@pytest.mark.parametrize("n_files", [1, 0])
def test_stream_route_equals_batch(spark, n_files):
    reqs = I.requests(spark, SF001).select("session_id", "ts", "event_id", "subject", "chapter",
                                           "content_source", "message", "conv_turn", "file")
    root = tempfile.mkdtemp(prefix="st1-")
    src = os.path.join(root, "in")
    _write_files(reqs, src, "conv_turn", n_files)
    stream = (spark.readStream.schema(reqs.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    hashes = (I.uploads(spark, SF001).select(F.col("path").alias("file_path"),
                                             F.sha2(F.col("content"), 256).alias("document_hash")))
    stream_route_intent(stream, os.path.join(root, "state"), os.path.join(root, "out"), os.path.join(root, "ck"), hashes,
                        every=3).awaitTermination()
    got = spark.read.parquet(os.path.join(root, "out"))
    want = Q.route_requests(spark, SF001)
    cols = ["event_id", "turn", "intent", "chapter_no", "cache_query", "document_hash", "key"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


@pytest.mark.parametrize("n_files", [1, 0])
def test_stream_current_document_equals_batch(spark, n_files):
    r, docs = Q.camera_documents(spark, SF001)
    turn = I.requests(spark, SF001).select("event_id", "conv_turn")
    docs = docs.select("session_id", "ts", "event_id", F.lit(0).alias("kind"), "doc_event_id", "doc_path", "if_none")
    qs = r.select("session_id", "ts", "event_id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("doc_event_id"),
                  F.lit(None).cast("string").alias("doc_path"), F.lit(None).cast("boolean").alias("if_none"))
    events = docs.unionByName(qs).join(turn, "event_id")
    root = tempfile.mkdtemp(prefix="st3-")
    src = os.path.join(root, "in")
    _write_files(events, src, "conv_turn", n_files)
    stream = (spark.readStream.schema(events.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    stream_current_document(stream, os.path.join(root, "state"), os.path.join(root, "out"), os.path.join(root, "ck"),
                            every=3).awaitTermination()
    got = spark.read.parquet(os.path.join(root, "out"))
    want = Q.current_document(spark, SF001)
    assert sorted(got.select("event_id", "doc_event_id", "doc_path").collect()) == sorted(want.collect())


@pytest.mark.parametrize("every", [20, 2])
def test_stream_cache_equals_batch_replay(spark, every):
    log = Q._log(spark, SF001).select("key", "ts", "event_id", "response", "conv_turn")
    root = tempfile.mkdtemp(prefix="st2-")
    src = os.path.join(root, "in")
    _write_files(log, src, "conv_turn", 0)
    stream = (spark.readStream.schema(log.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    q = stream_cache(stream, os.path.join(root, "index"), os.path.join(root, "out"), os.path.join(root, "ck"),
                     every=every)
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(root, "out")).select("event_id", "key", "hit", "served_text")
    want = cache.cache_replay(Q._log(spark, SF001)).select("event_id", "key", "hit", "served_text")
    assert sorted(got.collect()) == sorted(want.collect())


def _batches(spark, n, first=0):
    """Batch i: keys that recur from every earlier batch, and one new key."""
    return [spark.createDataFrame([(f"k{k}", 1000 * i + k, 1000 * i + k, f"answer {i}/{k}") for k in range(i + 1)],
                                  "key string, ts long, event_id long, response string") for i in range(first, n)]


@pytest.mark.parametrize("plan", [[2] * 7, [3, 3, 3, 2, 2, 2, 2, 4, 4]])
def test_index_survives_compactions(spark, plan):
    """Keys first seen before a snapshot recur after two snapshots and after ``every`` changed; the result is W3's."""
    root = tempfile.mkdtemp(prefix="st2c-")
    index, out = os.path.join(root, "index"), os.path.join(root, "out")
    batches = _batches(spark, len(plan))
    for i, (every, batch) in enumerate(zip(plan, batches)):
        process_batch(batch, i, index, out, every)
    assert len(os.listdir(os.path.join(index, "snapshots"))) >= 2
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.unionByName(b)
    got = spark.read.parquet(out).select("event_id", "key", "hit", "served_text").collect()
    want = cache.cache_replay(whole).select("event_id", "key", "hit", "served_text").collect()
    assert sorted(got) == sorted(want)
    # a retried batch, also one that wrote a snapshot, changes nothing
    last = len(plan) - 1
    process_batch(batches[last], last, index, out, plan[last])
    assert sorted(spark.read.parquet(out).select("event_id", "key", "hit", "served_text").collect()) == sorted(want)


def test_default_compaction_keeps_old_keys(spark):
    root = tempfile.mkdtemp(prefix="st2d-")
    index, out = os.path.join(root, "index"), os.path.join(root, "out")
    one = "key string, ts long, event_id long, response string"
    for i in range(COMPACT_EVERY + 1):
        process_batch(spark.createDataFrame([("old" if i in (0, COMPACT_EVERY) else f"k{i}", i, i, f"answer {i}")], one), i, index, out)
    row = spark.read.parquet(out).filter(F.col("event_id") == COMPACT_EVERY).first()
    assert (row.hit, row.served_text) == (True, "answer 0")


def test_missing_delta_raises(spark):
    root = tempfile.mkdtemp(prefix="st2m-")
    index, out = os.path.join(root, "index"), os.path.join(root, "out")
    batches = _batches(spark, 3)
    process_batch(batches[0], 0, index, out)
    os.rename(os.path.join(index, "deltas", "version=0"), os.path.join(root, "elsewhere"))
    with pytest.raises(MissingDelta):
        process_batch(batches[1], 1, index, out)


def test_streaming_route_feeds_streaming_cache(spark):
    """ST1 -> reply (stream-static) -> ST2 gives the batch W3 result."""
    reqs = I.requests(spark, SF001).select("session_id", "ts", "event_id", "subject", "chapter",
                                           "content_source", "message", "conv_turn", "file")
    root = tempfile.mkdtemp(prefix="st12-")
    src = os.path.join(root, "in")
    _write_files(reqs, src, "conv_turn", 0)
    stream = (spark.readStream.schema(reqs.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    hashes = (I.uploads(spark, SF001).select(F.col("path").alias("file_path"),
                                             F.sha2(F.col("content"), 256).alias("document_hash")))
    conv = I.conversations(spark, SF001)
    # the reply to request event e is the next row of its conversation, event e + 1
    replies = conv.filter(F.col("role") == "assistant").select(
        (F.col("conv_id") * EVENT_ID_MULT + F.col("turn") - 1).alias("event_id"), F.col("text").alias("reply"))
    state = turn_state(os.path.join(root, "turns"), 3)

    def step(batch, batch_id):
        routed = (route_batch(batch, batch_id, state, hashes).join(replies, "event_id", "left")
                  .select("key", "ts", "event_id", F.coalesce(F.col("reply"), F.lit("")).alias("response")))
        process_batch(routed, batch_id, os.path.join(root, "index"), os.path.join(root, "out"), 3)

    (stream.writeStream.option("checkpointLocation", os.path.join(root, "ck")).foreachBatch(step)
     .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(os.path.join(root, "out")).select("event_id", "key", "hit", "served_text")
    want = cache.cache_replay(Q._log(spark, SF001)).select("event_id", "key", "hit", "served_text")
    assert sorted(got.collect()) == sorted(want.collect())


def _state(root, **more):
    return KeyedState(os.path.join(root, "state"), "key string", "n long", **more)


def _set(spark, state, batch_id, pairs):
    state.write(spark.createDataFrame(pairs, "key string, n long"), batch_id)


def _get(spark, state, batch_id, keys):
    return {r["key"]: r["n"] for r in state.before(spark.createDataFrame([(k,) for k in keys], "key string"), batch_id).collect()}


def test_state_reads_only_its_keys_buckets(spark):
    """With 2,000 keys stored, a batch of one key opens the files of one bucket: one snapshot, and its part of the deltas."""
    state = _state(tempfile.mkdtemp(prefix="state-"), every=3, buckets=16)
    for i in range(5):
        _set(spark, state, i, [(f"k{k}", 10 * i + k) for k in range(i, 2000, i + 1)])
    keys = spark.createDataFrame([("k7",), ("none",)], "key string")
    found = state.before(keys.filter("key = 'k7'"), 5)
    files = found.inputFiles()
    buckets = {f.split("bucket=")[1].split("/")[0] for f in files if "/snapshots/" in f}
    assert len(buckets) == 1 and len([f for f in files if "/snapshots/" in f]) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    wrote = {k: max(i for i in range(5) if k >= i and (k - i) % (i + 1) == 0) for k in (7, 8, 1999)}
    assert _get(spark, state, 5, ["k7", "k8", "k1999", "none"]) == {f"k{k}": 10 * i + k for k, i in wrote.items()}


def test_state_keeps_what_a_retry_needs_and_no_more(spark):
    root = tempfile.mkdtemp(prefix="state-")
    state = _state(root, every=2, buckets=4)
    for i in range(8):
        _set(spark, state, i, [("a", i), (f"b{i}", i)])
    store = Store(spark, state.root)
    assert store.ids("manifests", "upto=") == [5, 7] and store.ids("deltas", "version=") == [6, 7]
    before = _get(spark, state, 8, ["a", "b0", "b7"])
    assert before == {"a": 7, "b0": 0, "b7": 7}
    assert _get(spark, state, 7, ["a", "b0", "b7"]) == {"a": 6, "b0": 0}        # what a retry of batch 7 sees
    _set(spark, state, 7, [("a", 7), ("b7", 7)])
    assert _get(spark, state, 8, ["a", "b0", "b7"]) == before


def test_state_buckets_double_with_the_data(spark):
    state = _state(tempfile.mkdtemp(prefix="state-"), every=1, buckets=2, bucket_rows=50)
    for i in range(6):
        _set(spark, state, i, [(f"k{k}", i) for k in range(100 * i, 100 * i + 100)] + [("k0", i)][:i])
    _, n, placed = state._manifest(spark, Store(spark, state.root), 6)
    assert n >= 8 and sum(rows for _, rows in placed.values()) == 600
    assert _get(spark, state, 6, ["k0", "k599", "k101", "x"]) == {"k0": 5, "k599": 5, "k101": 1}


def test_untouched_buckets_are_not_rewritten(spark):
    state = _state(tempfile.mkdtemp(prefix="state-"), every=1, buckets=32)
    _set(spark, state, 0, [(f"k{k}", k) for k in range(300)])
    _set(spark, state, 1, [("k5", -1)])
    store = Store(spark, state.root)
    _, _, placed = state._manifest(spark, store, 2)
    assert sorted(u for u, _ in placed.values()) == [0] * (len(placed) - 1) + [1]
    assert len(store.ids("snapshots/upto=1", "bucket=")) == 1
    assert _get(spark, state, 2, ["k5", "k6"]) == {"k5": -1, "k6": 6}


def test_cache_serves_a_stored_null(spark):
    """A key answered with null is known: it is served, not answered anew."""
    root = tempfile.mkdtemp(prefix="st2n-")
    index, out = os.path.join(root, "index"), os.path.join(root, "out")
    one = "key string, ts long, event_id long, response string"
    process_batch(spark.createDataFrame([("k", 1, 1, None)], one), 0, index, out)
    process_batch(spark.createDataFrame([("k", 2, 2, "late")], one), 1, index, out)
    rows = {r.event_id: (r.hit, r.served_text) for r in spark.read.parquet(out).collect()}
    assert rows == {1: (False, None), 2: (True, None)}
    assert index_state(index).before(spark.createDataFrame([("k",)], "key string"), 2).count() == 1
