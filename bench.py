"""Benchmark the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is executed in
full through the ``noop`` sink (nothing is collected to the driver);
seconds are the median of ``$BENCH_REPEATS`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# BASELINE bench plan: document_profile, T1+P5+P9, T2, T3, T14+J2, W3, W2+A1+U3, J3, A2
HEADLINE = ["document_profile", "route_requests", "clean_answers", "speech_text", "cache_lookup",
            "cache_replay", "extraction_choice", "current_document", "render_transcript"]
# the driver tables each query reads (BASELINE asks for input rows per query)
SOURCES = {"document_profile": ["documents"], "route_requests": ["conversations", "pages"],
           "clean_answers": ["conversations"], "speech_text": ["conversations"],
           "cache_lookup": ["conversations", "pages"], "cache_replay": ["conversations", "pages"],
           "extraction_choice": ["documents"], "current_document": ["conversations"],
           "render_transcript": ["conversations", "pages"]}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE

    from chalkline.plans.queries import QUERIES
    from chalkline.session import local_session
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="chalkline-bench")

    from chalkline.sources.tables import read_table
    table_rows = {}

    def input_rows(name):
        total = 0
        for t in SOURCES.get(name, []):
            if t not in table_rows:
                table_rows[t] = read_table(spark, sf_dir, t).count()
            total += table_rows[t]
        return total

    timings, rows, inputs = {}, {}, {}
    for name in names:
        df_fn = QUERIES[name]
        runs = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            df_fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 3)
        rows[name] = df_fn(spark, sf_dir).count()
        inputs[name] = input_rows(name)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "rows": rows, "input_rows": inputs,
                      "sf": float(m.group(1)) if m else sf_dir,
                      "cores": int(cpus), "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
