"""File sources and sinks (S1-S4, S8, S9) on scratch folders."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from chalkline.functions.keys import payload_struct
from chalkline.sources.files import content_catalog, scan_uploads
from chalkline.sources.index import META, load_response_index, read_index, write_response_index
from chalkline.sources.sinks import HISTORY, audit_sink, history_sink, read_committed
from tests.test_operators import _py_key


def test_content_catalog_and_uploads(spark):
    root = tempfile.mkdtemp(prefix="catalog-")
    for subject, n in (("math", 1), ("math", 12), ("hindi", 3)):
        os.makedirs(os.path.join(root, subject), exist_ok=True)
        with open(os.path.join(root, subject, f"chapter{n}.pdf"), "wb") as f:
            f.write(b"%PDF-" + bytes([n]))
    with open(os.path.join(root, "math", "notes.pdf"), "wb") as f:
        f.write(b"x")
    got = sorted((r.subject, r.chapter) for r in content_catalog(spark, root).collect())
    assert got == [("hindi", 3), ("math", 1), ("math", 12)]
    files = scan_uploads(spark, root, with_content=False)
    assert "content" not in files.columns and files.count() == 4
    found = scan_uploads(spark, root, max_bytes=1).collect()
    assert sorted((r.length, r.status, r.content is None) for r in found) == [(1, "ok", False)] + [(6, "too_large", True)] * 3


def test_response_index_import_and_versions(spark):
    d = tempfile.mkdtemp(prefix="index-")
    meta = {"intent": "greeting", "subject": "Hindi", "chapter_number": 1,
            "content_source": "Camera Document (📱 NEW!)", "student_query": "", "document_hash": None}
    key = _py_key(meta)
    path = os.path.join(d, "index.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({key: {"text": "नमस्ते", "audio_path": None, "meta": meta}}, f, ensure_ascii=True, indent=2)
    idx = load_response_index(spark, path, version=1)
    rows = idx.collect()
    assert len(rows) == 1 and rows[0].key == key and rows[0].key_matches and rows[0].text == "नमस्ते"
    assert load_response_index(spark, os.path.join(d, "missing.json")).count() == 0
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        f.write("{not json")
    assert load_response_index(spark, bad).count() == 0

    base = os.path.join(d, "store")
    write_response_index(idx.drop("key_matches"), base, 1)
    upd = idx.drop("key_matches").withColumn("text", F.lit("new"))
    write_response_index(upd, base, 2)
    latest = read_index(spark, base).collect()
    assert [(r.key, r.text, r.version) for r in latest] == [(key, "new", 2)]


def test_sinks_append_once(spark):
    d = tempfile.mkdtemp(prefix="sinks-")
    q = spark.createDataFrame([("What is cricket?", "Math")], "question string, subject string")
    audit = os.path.join(d, "audit")
    for batch_id in (1, 1, 2):                              # batch 1 is retried
        audit_sink(q, "unknown_question", audit, batch_id)
    a = spark.read.parquet(audit)
    assert a.filter("kind = 'unknown_question'").count() == 2
    seen = read_committed(spark, os.path.join(audit, "kind=unknown_question"), "question string, subject string")
    assert sorted(r["batch"] for r in seen.collect()) == ["1", "2"]
    h = spark.createDataFrame([(1, 1, "hi", "Hello", None)], HISTORY)
    path = os.path.join(d, "history")
    assert read_committed(spark, path, HISTORY).count() == 0
    for batch_id in ("job-7", "job-7", "job-8"):
        history_sink(h, path, batch_id)
    os.remove(os.path.join(path, "batch=job-8", "_SUCCESS"))  # a job that did not commit
    assert [tuple(r) for r in read_committed(spark, path, HISTORY).collect()] == [(1, 1, "hi", "Hello", None, "job-7")]


def test_index_lookup_does_not_shuffle_the_index(spark):
    from chalkline.operators.cache import cache_lookup
    base = os.path.join(tempfile.mkdtemp(prefix="index-"), "store")
    assert read_index(spark, base).count() == 0
    meta = f"cast(null as {META})"
    rows = spark.range(500).selectExpr("sha2(cast(id as string), 256) as key", "concat('t', id) as text", "cast(null as string) as audio_path", f"{meta} as meta")
    write_response_index(rows.limit(3), base, 1, 4)
    write_response_index(rows, base, 2, 8)
    write_response_index(rows, base, 2, 8)                    # a retry
    write_response_index(rows.limit(1), base, 3, 8)
    os.remove(os.path.join(base, "version=3", "buckets=8", "_SUCCESS"))
    index = read_index(spark, base)
    assert index.count() == 500 and {r["version"] for r in index.select("version").distinct().collect()} == {2}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(490, 510).selectExpr("id", "sha2(cast(id as string), 256) as key")
        found = cache_lookup(asked, index)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") == 1 and "SelectedBucketsCount: 8 out of 8" in plan
        got = {r["id"]: r["cached_text"] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: f"t{i}" if i < 500 else None for i in range(490, 510)}


def test_payload_struct_key_matches(spark):
    from chalkline.functions.keys import meta_key, cache_key
    df = spark.createDataFrame([("follow_up", "Math", 2, "Chapter", "why?", None)],
                               "i string, s string, c int, src string, q string, h string")
    r = df.select(cache_key("i", "s", "c", "src", "q", "h").alias("k"),
                  meta_key(payload_struct("i", "s", "c", "src", "q", "h")).alias("m")).collect()[0]
    assert r.k == r.m
