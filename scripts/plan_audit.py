"""Audit the physical plan of every registered query.

Usage: python scripts/plan_audit.py [sf_dir]
Reports, per query, the number of exchanges and any operator that does not
belong in a plan meant for large inputs: cartesian products, nested-loop
joins, Python evaluation (row-at-a-time or Arrow), and single-partition
exchanges (expected only as the final merge of a global aggregate, a
top-k, or a window over a bounded number of rows).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def audit(spark, sf: str):
    from ledgerlake.plans import catalog
    for name, fn in catalog.queries().items():
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        found = [k for k in FORBIDDEN if k in plan]
        yield name, plan.count("Exchange"), plan.count("SinglePartition"), found


def main():
    from ledgerlake.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    bad = 0
    for name, ex, single, found in audit(spark, sf):
        bad += bool(found)
        print(f"{name:42s} exchanges={ex:2d} single_partition={single} {' '.join(found)}")
    print(f"== {bad} queries with forbidden operators")


if __name__ == "__main__":
    main()
