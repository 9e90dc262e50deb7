"""Per-user and global activity aggregates: overviews, chargeback and decline ratios.

All are single ``groupBy().agg()`` plans: Spark aggregates partially inside each
scan task and shuffles only one partial row per (task, user), so a user holding
a large share of the rows does not concentrate raw rows in one task.

Rules kept from the source analyses:
* ratios are ``count / NULLIF(count, 0)`` as double; a user with chargebacks
  and no purchases has a null ratio and fails every ratio filter;
* percent = ratio * 100, computed in that order (it decides which side of a
  threshold a double lands on);
* thresholds keep their strictness: purchases > 20, percent > 3, chargebacks
  >= 2, percent >= 2, decline rate > 0.40 with at least 10 transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.exprs import (
    count_where,
    mean_exact,
    ratio,
    sum_flag,
    sum_money,
    sum_where,
)

PURCHASE = "purchase"
CHARGEBACK = "chargeback"
APPROVED = "approved"
DECLINED = "declined"


def _distinct(col: str, approx_rsd: float | None) -> F.Column:
    """Exact ``COUNT(DISTINCT col)``, or a HyperLogLog++ estimate when
    ``approx_rsd`` (relative standard deviation) is given: one pass with a
    fixed-size sketch per task instead of shuffling (key, value) partials."""
    return F.countDistinct(col) if approx_rsd is None else F.approx_count_distinct(col, rsd=approx_rsd)


def fraud_overview(
    tx: DataFrame,
    *,
    user: str = "user_id",
    type_col: str = "tx_type",
    amount: str = "amount",
    approx_rsd: float | None = None,
) -> DataFrame:
    """One row: total amount over all types, distinct users, purchases, chargebacks."""
    t = F.col(type_col)
    return tx.agg(
        sum_money(amount).alias("total_amount"),
        _distinct(user, approx_rsd).alias("unique_users"),
        count_where(t == PURCHASE).alias("purchase_count"),
        count_where(t == CHARGEBACK).alias("chargeback_count"),
    )


def user_chargeback_counts(
    tx: DataFrame,
    *,
    user: str = "user_id",
    type_col: str = "tx_type",
    amount: str = "amount",
) -> DataFrame:
    """Per user: purchase_count, chargeback_count, purchase_volume (null if no purchase).

    Unused outputs are pruned by Catalyst, so callers that drop
    ``purchase_volume`` do not read the amount column.
    """
    t = F.col(type_col)
    return tx.groupBy(user).agg(
        count_where(t == PURCHASE).alias("purchase_count"),
        count_where(t == CHARGEBACK).alias("chargeback_count"),
        sum_where(amount, t == PURCHASE).cast("decimal(38,2)").alias("purchase_volume"),
    )


def chargeback_ratio(tx: DataFrame, *, user: str = "user_id", type_col: str = "tx_type") -> DataFrame:
    """Users with a positive chargebacks / purchases ratio."""
    counts = user_chargeback_counts(tx, user=user, type_col=type_col)
    r = ratio(F.col("chargeback_count"), F.col("purchase_count"))
    return counts.select(user, "purchase_count", "chargeback_count", r.alias("chargeback_ratio")).filter(
        F.col("chargeback_ratio") > 0
    )


def high_risk_users(
    tx: DataFrame,
    min_purchases: int = 20,
    min_ratio_pct: float = 3,
    *,
    user: str = "user_id",
    type_col: str = "tx_type",
) -> DataFrame:
    """purchase_count > min_purchases and chargeback percent > min_ratio_pct."""
    counts = user_chargeback_counts(tx, user=user, type_col=type_col)
    pct = ratio(F.col("chargeback_count"), F.col("purchase_count")) * F.lit(100)
    return counts.select(user, "purchase_count", "chargeback_count", pct.alias("chargeback_ratio_pct")).filter(
        (F.col("purchase_count") > min_purchases) & (F.col("chargeback_ratio_pct") > min_ratio_pct)
    )


def risk_triage(
    tx: DataFrame,
    min_chargebacks: int = 2,
    min_ratio_pct: float = 2,
    n: int | None = 10,
    *,
    user: str = "user_id",
    type_col: str = "tx_type",
    amount: str = "amount",
) -> DataFrame:
    """Review list: chargebacks >= 2 and percent >= 2, ranked by chargebacks,
    percent and purchase volume (all descending), top ``n``.

    ``user`` ascending breaks ties so the top-n is deterministic. With ``n``
    set, Spark plans a TakeOrderedAndProject (per-task top-n, then a merge of
    n rows per task) instead of a full sort.
    """
    counts = user_chargeback_counts(tx, user=user, type_col=type_col, amount=amount)
    pct = ratio(F.col("chargeback_count"), F.col("purchase_count")) * F.lit(100)
    out = counts.select(
        user,
        "purchase_count",
        "chargeback_count",
        "purchase_volume",
        pct.alias("chargeback_ratio_pct"),
    ).filter((F.col("chargeback_count") >= min_chargebacks) & (F.col("chargeback_ratio_pct") >= min_ratio_pct))
    out = out.orderBy(
        F.col("chargeback_count").desc(),
        F.col("chargeback_ratio_pct").desc(),
        F.col("purchase_volume").desc(),
        F.col(user).asc(),
    )
    return out.limit(n) if n is not None else out


def payments_overview(
    tx: DataFrame,
    *,
    user: str = "user_id",
    merchant: str = "merchant_id",
    status: str = "status",
    amount: str = "amount",
    approx_rsd: float | None = None,
) -> DataFrame:
    """One row: count, approved, declined, distinct users and merchants, total and mean amount."""
    s = F.col(status)
    return tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        sum_flag(s == APPROVED).alias("approved_tx"),
        sum_flag(s == DECLINED).alias("declined_tx"),
        _distinct(user, approx_rsd).alias("unique_users"),
        _distinct(merchant, approx_rsd).alias("unique_merchants"),
        sum_money(amount).alias("total_volume"),
        mean_exact(amount).alias("avg_tx_amount"),
    )


def user_behaviour(
    tx: DataFrame,
    *,
    user: str = "user_id",
    status: str = "status",
    amount: str = "amount",
    ordered: bool = True,
) -> DataFrame:
    """Per user: transaction count, approved, declined, total and mean amount."""
    s = F.col(status)
    out = tx.groupBy(user).agg(
        F.count(F.lit(1)).alias("total_tx"),
        sum_flag(s == APPROVED).alias("approved_tx"),
        sum_flag(s == DECLINED).alias("declined_tx"),
        sum_money(amount).alias("total_amount"),
        mean_exact(amount).alias("avg_amount"),
    )
    return out.orderBy(F.col("total_tx").desc(), F.col(user).asc()) if ordered else out


def high_decline(
    tx: DataFrame,
    min_tx: int = 10,
    min_rate: float = 0.40,
    *,
    user: str = "user_id",
    status: str = "status",
    ordered: bool = True,
) -> DataFrame:
    """Users with at least ``min_tx`` transactions and decline rate > ``min_rate``."""
    s = F.col(status)
    out = (
        tx.groupBy(user)
        .agg(F.count(F.lit(1)).alias("total_tx"), sum_flag(s == DECLINED).alias("declined_tx"))
        .withColumn("decline_rate", F.col("declined_tx").cast("double") / F.col("total_tx"))
        .filter((F.col("total_tx") >= min_tx) & (F.col("decline_rate") > min_rate))
    )
    return out.orderBy(F.col("decline_rate").desc(), F.col("total_tx").desc(), F.col(user).asc()) if ordered else out
