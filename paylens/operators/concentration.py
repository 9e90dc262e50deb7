"""Share of a user's transactions at their most used counterparty (merchant).

Two partial aggregates instead of two window counts over all rows: count per
(user, merchant), then per user the max and the sum of those counts. The
first level is spread by (user, merchant), so a user with a huge history is
not one task; both levels combine map-side before shuffling. The share is
``max(count) / total`` as double, which equals the max of the per-merchant
ratios (division by the same total is monotonic). A null merchant is a group
of its own, as in a window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concentration(
    tx: DataFrame,
    column: str = "merchant_id",
    min_ratio: float = 0.60,
    min_total: int = 10,
    *,
    user: str = "user_id",
    name: str = "highest_merchant_ratio",
    ordered: bool = True,
) -> DataFrame:
    """Users with >= ``min_total`` transactions whose top ``column`` share is > ``min_ratio``."""
    per_pair = tx.groupBy(user, column).agg(F.count(F.lit(1)).alias("_n"))
    per_user = per_pair.groupBy(user).agg(
        F.sum("_n").alias("total_tx"),
        F.max("_n").alias("_top"),
    )
    out = per_user.select(
        user,
        F.col("total_tx").cast("bigint").alias("total_tx"),
        (F.col("_top").cast("double") / F.col("total_tx")).alias(name),
    ).filter((F.col(name) > min_ratio) & (F.col("total_tx") >= min_total))
    return out.orderBy(F.col(name).desc(), F.col("total_tx").desc(), F.col(user).asc()) if ordered else out
