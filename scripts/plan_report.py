"""Write PLANS.md: the physical shape of every registered query.

For each query on the materialized purchases fact: distinct Parquet scan
nodes, shuffle exchanges, broadcast exchanges, join strategies, windows and
scalar subqueries, read from ``explain("formatted")``.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shape(text: str) -> dict:
    ids = lambda name: set(re.findall(rf"{name}\s+\((\d+)\)", text))
    return {
        "scans": len(ids(r"Scan parquet ")),
        "exchanges": len(ids(r"(?<!Broadcast)(?<!Reused)Exchange")),
        "broadcasts": len(ids(r"BroadcastExchange")),
        "smj": len(ids(r"SortMergeJoin(?: \w+)*")),
        "bhj": len(ids(r"BroadcastHashJoin(?: \w+)*")),
        "bnlj": len(ids(r"BroadcastNestedLoopJoin(?: \w+)*")),
        "windows": len(ids(r"Window")),
        "subqueries": len(set(re.findall(r"Subquery subquery#(\d+)", text))),
        "take_ordered": len(ids(r"TakeOrderedAndProject")),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from storelens.plans import inspect
    from storelens.plans.catalog import QUERIES
    from storelens.session import build_session, shared_dir
    from storelens.sources.star import MATERIALIZE_CONF

    spark = build_session("local[8]", 8)
    try:
        shared_dir(spark)
    except RuntimeError:
        shared_dir(spark, tempfile.mkdtemp(prefix="storelens-plans-"))
    spark.conf.set(MATERIALIZE_CONF, "true")
    rows = []
    for name, q in QUERIES.items():
        df = q(spark, sf_dir)
        rows.append((name, shape(inspect.plan_text(df))))
    cols = ["scans", "exchanges", "broadcasts", "smj", "bhj", "bnlj", "windows", "subqueries", "take_ordered"]
    print("# PLANS — physical shape of every registered query\n")
    print(
        "Generated by `scripts/plan_report.py` from `explain(\"formatted\")` on the materialized purchases\n"
        "fact (before AQE re-planning). `scans` counts distinct Parquet scan nodes of the main plan and its\n"
        "scalar subqueries; `exchanges` are shuffles; `broadcasts` are broadcast exchanges (AQE keeps them\n"
        "only for sides measured under the threshold, or for lists bounded by `n`); `bnlj` must stay 0.\n"
    )
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, s in rows:
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
