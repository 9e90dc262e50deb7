"""Range partitioning with explicit bucket numbers.

``repartitionByRange`` hides which range a row fell into and samples anew for
every plan, so two jobs may cut differently. Here the cut points are plain
values: the bucket of a row is an ordinary column, equal in every job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_bucket(key: Column, cuts: Column, n_cuts: int) -> Column:
    """Number of cut points below ``key``: a binary search in ``cuts``, a sorted
    array of ``n_cuts`` values of the key's type. Null keys are in bucket 0."""
    step, steps = 1, []
    while step <= n_cuts:
        steps.append(step)
        step *= 2
    if not steps:
        return F.lit(0)

    def descend(low, add):
        return F.when((low + add <= n_cuts) & (F.get(cuts, low + add - 1) < key), low + add).otherwise(low)

    return F.aggregate(F.lit(steps[::-1]), F.lit(0), descend)


def number_cuts(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets - 1`` cut points of an integer column with about as many
    rows between each two (percentile sketch, partial per task)."""
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * buckets)).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))
