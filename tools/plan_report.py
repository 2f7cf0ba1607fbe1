"""Summarise the final (adaptive) physical plan of the headline queries.

Usage: python tools/plan_report.py [sf_dir]
Runs each query once through the noop sink, then counts exchanges, join
strategies, aggregates and windows in the executed plan.
"""

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    lines = plan.splitlines()
    c = Counter()
    for ln in lines:
        s = ln.strip().lstrip("+-: ").strip()
        for key in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
                    "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window", "Generate",
                    "BroadcastExchange", "ReusedExchange", "FileScan", "Scan ExistingRDD", "AQEShuffleRead"):
            if s.startswith(key):
                c[key] += 1
        m = re.match(r"Exchange (\w+)", s)
        if m:
            c["Exchange " + m.group(1)] += 1
    c["partial aggregates"] = plan.count("partial_")
    c["python nodes"] = sum(plan.count(k) for k in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"))
    return dict(sorted(c.items()))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from bench import HEADLINE
    from chalkline.plans.queries import QUERIES
    from chalkline.session import local_session
    spark = local_session(cores=8, shuffle_partitions=16, app="plan-report")
    for name in HEADLINE:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        qe = df._jdf.queryExecution().executedPlan()
        text = qe.toString()
        if hasattr(qe, "finalPhysicalPlan"):
            text = qe.finalPhysicalPlan().toString()
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", text)) - {""})
        print(f"{name}: {summarise(text)}" + (f" pushed={pushed}" if pushed else ""))


if __name__ == "__main__":
    main()
