"""Shuffle profile of every registered query, from its physical plan.

Usage: python tools/plan_summary.py [sf_dir] [--at-scale]

``--at-scale`` turns off Spark's automatic broadcast (as if every table were
far above the threshold, as at 100 TB).

Prints a Markdown table: per key, the Parquet scans, hash exchanges over raw
rows, hash exchanges over partial aggregates, range exchanges (global sorts),
broadcast exchanges, join strategies, window operators and top-k nodes. The
plan is the one Spark builds before running (AQE may still coalesce
partitions, switch a join to broadcast or split skewed partitions).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paylens.plans.explain import plan_text, shuffle_profile  # noqa: E402
from paylens.session import build_session  # noqa: E402


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    root = args[0] if args else "/root/testdata/sf0.1"
    from paylens.plans.registry import QUERIES as qs  # only plans: others run jobs while they are built

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1"} if "--at-scale" in sys.argv else {}
    spark = build_session(master="local[8]", shuffle_partitions=8, extra_conf=conf)
    cols = ["scans", "raw_shuffles", "agg_shuffles", "range", "broadcast", "joins", "windows", "topk"]
    print("| key | " + " | ".join(cols) + " |")
    print("| --- " * (len(cols) + 1) + "|")
    for key in sorted(qs):
        s = shuffle_profile(plan_text(qs[key](spark, root)))
        print(f"| {key} | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
