"""Run every registered query and its DuckDB oracle; report matches.

Usage: python scripts/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlake.plans.oracle import check  # noqa: E402
from ledgerlake.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = set(sys.argv[2:]) or None
    spark = build_session()
    counts = {"ok": 0, "fail": 0, "rows": 0}
    for name, status, n, secs, msg in check(spark, sf, names):
        counts[status] += 1
        print(f"{status:4} {name}: {n} rows {secs:.1f}s {msg[:1500]}")
    print(f"== {counts['ok']} ok, {counts['fail']} failing, {counts['rows']} rows-only")


if __name__ == "__main__":
    main()
