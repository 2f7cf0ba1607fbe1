"""Hot keys: one session / one cache key holding most rows.

Results are checked against a brute-force Python model, and the plans are
checked to keep row-level windows off a bare session key."""

import datetime as dt
import random

from pyspark.sql import functions as F

from chalkline.operators import asof, cache, sessions
from chalkline.operators.ranges import cut_hot_groups


def _events(spark, n_hot=3000, n_cold=300, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n_hot):                       # session 0 holds most rows, over many hours
        rows.append((0, base + dt.timedelta(seconds=rnd.randrange(0, 50 * 3600)), i, rnd.random() < 0.05))
    for i in range(n_cold):
        rows.append((1 + i % 30, base + dt.timedelta(seconds=rnd.randrange(0, 50 * 3600)), 10_000 + i,
                     rnd.random() < 0.2))
    return rows


def test_hot_session_turns_and_documents(spark):
    rows = _events(spark)
    df = spark.createDataFrame(rows, "session_id long, ts timestamp, event_id long, is_doc boolean")
    got = {r.event_id: r.turn for r in sessions.number_turns(df).collect()}
    by_session = {}
    for s, ts, e, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_session.setdefault(s, []).append(e)
    want = {e: i + 1 for evs in by_session.values() for i, e in enumerate(evs)}
    assert got == want

    docs = df.filter("is_doc").select("session_id", "ts", "event_id", F.col("event_id").alias("doc_event_id"))
    qs = df.filter("not is_doc").select("session_id", "ts", "event_id")
    got_doc = {r.event_id: (r.doc.doc_event_id if r.doc else None) for r in asof.current_document(qs, docs).collect()}
    want_doc, last = {}, {}
    for s, ts, e, is_doc in sorted(rows, key=lambda r: (r[0], r[1], r[2], 0 if r[3] else 1)):
        if is_doc:
            last[s] = e
        else:
            want_doc[e] = last.get(s)
    assert got_doc == want_doc


def test_burst_inside_one_second(spark):
    """Two thirds of all rows in one second of one session are cut into ranges; turns and documents stay right."""
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows = [(0, base + dt.timedelta(microseconds=rnd.randrange(0, 4000)), i, rnd.random() < 0.02, rnd.random() < 0.5) for i in range(4000)]
    rows += [(1 + i % 7, base + dt.timedelta(seconds=i), 10_000 + i, rnd.random() < 0.1, rnd.random() < 0.7) for i in range(2000)]
    df = spark.createDataFrame(rows, "session_id long, ts timestamp, event_id long, is_doc boolean, if_none boolean")
    cut = cut_hot_groups(df.withColumn("b", F.lit(0)), ["session_id", "b"], ["ts", "event_id"], "cut", hot_rows=1000)
    sizes = cut.groupBy("session_id", "cut").count().collect()
    assert max(r["count"] for r in sizes if r["session_id"] == 0) < 800
    assert {r["cut"] for r in sizes if r["session_id"] != 0} == {0}
    ranges = cut.filter("session_id = 0").groupBy("cut").agg(F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("z"))
    ordered = ranges.orderBy("cut").collect()
    assert all(x["z"] < y["a"] for x, y in zip(ordered, ordered[1:]))

    got = {r.event_id: r.turn for r in sessions.number_turns(df, hot_rows=1000).collect()}
    by_session = {}
    for r in sorted(rows, key=lambda r: r[:3]):
        by_session.setdefault(r[0], []).append(r[2])
    assert got == {e: i + 1 for evs in by_session.values() for i, e in enumerate(evs)}

    docs = df.filter("is_doc").select("session_id", "ts", "event_id", "if_none", F.col("event_id").alias("doc_event_id"))
    qs = df.filter("not is_doc").select("session_id", "ts", "event_id")
    stored = {0: -5, 3: -3}
    for before in ({}, stored):
        held = spark.createDataFrame(list(before.items()), "session_id long, doc_event_id long") if before else None
        seen = asof.current_document(qs, docs, hot_rows=1000, before=held)
        got_doc = {r.event_id: (r.doc.doc_event_id if r.doc else None) for r in seen.collect()}
        state, want = dict(before), {}
        for s, _, e, is_doc, if_none in sorted(rows, key=lambda r: r[:3]):
            if not is_doc:
                want[e] = state.get(s)
            elif not if_none or s not in state:
                state[s] = e
        assert got_doc == want
        after = {r.session_id: (r._last or before.get(r.session_id) or r._first) for r in asof.stored_after(docs).withColumns(
            {"_last": F.col("_last.doc_event_id"), "_first": F.col("_first.doc_event_id")}).collect()}
        assert after == {s: d for s, d in state.items() if s in after}


def test_hot_cache_key(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    keys = ["HOT" if rnd.random() < 0.6 else f"k{rnd.randrange(200)}" for _ in range(4000)]
    rows = [(k, base + dt.timedelta(seconds=i), i, f"r{i}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id long, response string")
    got = {r.event_id: (r.hit, r.served_text) for r in cache.cache_replay(df).collect()}
    first = {}
    for k, _, i, resp in rows:
        first.setdefault(k, resp)
    assert got == {i: (first[k] != resp, first[k]) for k, _, i, resp in rows}


def test_no_row_window_on_bare_session(spark):
    rows = _events(spark, 50, 10)
    df = spark.createDataFrame(rows, "session_id long, ts timestamp, event_id long, is_doc boolean")
    plan = sessions.number_turns(df)._jdf.queryExecution().executedPlan().toString()
    # the only window keyed by session alone runs over the (session, bucket) counts
    for line in plan.splitlines():
        if "row_number()" in line:
            assert "_bucket" in line.split("windowspecdefinition(")[1].split(",")[1]
    assert "partial_count" in plan
