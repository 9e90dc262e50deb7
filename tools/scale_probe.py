"""How operator time grows with data: the sf events replicated k times.

Usage: python tools/scale_probe.py [sf_dir] [k ...]

Each copy of the events gets its own user ids (user_id * k + copy), so the
number of users grows with k and per-user density stays the same; the
``hot`` rows put a third of all rows on one user instead. Replication uses a
generator (``explode``), not a join. Prints one JSON line per (k, query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from paylens.operators import activity, recency, trailing  # noqa: E402
from paylens.session import build_session  # noqa: E402
from paylens.sources.adapters import Dataset  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    root = args[0] if args else "/root/testdata/sf0.1"
    ks = [int(a) for a in args[1:]] or [1, 4, 16]
    spark = build_session(
        master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", shuffle_partitions=int(os.environ.get("BENCH_CPUS", "8")), extra_conf={"spark.driver.memory": "16g"}
    )
    base = Dataset(spark, root).transactions()
    for k in ks:
        copies = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_copy"))
        tx = copies.withColumn("user_id", F.col("user_id") * k + F.col("_copy")).drop("_copy")
        hot = tx.withColumn(
            "user_id", F.when(F.col("transaction_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
        )
        cases = {
            "risk_triage": lambda d: activity.risk_triage(d),
            "velocity_24h": lambda d: recency.recent_count(d, 24, name="n", ordered=False),
            "multi_country_24h": lambda d: trailing.trailing_distinct(d, "country", "24 hours", 2, name="n", ordered=False),
            "card_testing_24h": lambda d: trailing.trailing_count(d, "24 hours", 3, name="n", ordered=False),
        }
        for name, build in cases.items():
            for label, data in (("even", tx), ("hot", hot)):
                best = float("inf")
                for _ in range(2):
                    t0 = time.perf_counter()
                    build(data).write.format("noop").mode("overwrite").save()
                    best = min(best, time.perf_counter() - t0)
                print(json.dumps({"k": k, "rows": 100_000 * k, "query": name, "data": label, "sec": round(best, 2)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
