"""Registered queries: key -> callable(spark, dataset_root) -> DataFrame.

Each entry reads the whole dataset tables through the adapters and runs one
operator. ``ORACLE`` (``plans/oracle.py``) holds the DuckDB equivalent per key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.operators import activity, catalog, concentration, ledger, matching, quality, recency, trailing
from paylens.plans import params as P
from paylens.sources.adapters import Dataset
from paylens.sources.schemas import KEYS

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
#: The same on any dataset, a stored one for example.
REPORTS: dict[str, Callable[[Dataset], DataFrame]] = {}


def register(key: str):
    def deco(fn: Callable[[Dataset], DataFrame]) -> Callable[[Dataset], DataFrame]:
        REPORTS[key] = fn
        QUERIES[key] = lambda spark, root: fn(Dataset(spark, root))
        return fn

    return deco


# ---- activity ----------------------------------------------------------------
@register("c1_overview")
def _c1_overview(d: Dataset) -> DataFrame:
    return activity.fraud_overview(d.transactions())


@register("c1_chargeback_ratio")
def _c1_chargeback_ratio(d: Dataset) -> DataFrame:
    return activity.chargeback_ratio(d.transactions())


@register("c1_high_risk_users")
def _c1_high_risk_users(d: Dataset) -> DataFrame:
    return activity.high_risk_users(d.transactions())


@register("c1_risk_triage")
def _c1_risk_triage(d: Dataset) -> DataFrame:
    return activity.risk_triage(d.transactions())


@register("c2_overview")
def _c2_overview(d: Dataset) -> DataFrame:
    return activity.payments_overview(d.transactions())


@register("c2_user_behaviour")
def _c2_user_behaviour(d: Dataset) -> DataFrame:
    return activity.user_behaviour(d.transactions())


@register("c2_high_decline")
def _c2_high_decline(d: Dataset) -> DataFrame:
    return activity.high_decline(d.transactions())


# ---- ledger (accounts payable) -------------------------------------------------
@register("ap_open_balance")
def _ap_open_balance(d: Dataset) -> DataFrame:
    return ledger.open_balance(d.bills(), d.payment_applications())


@register("ap_unapplied_payments")
def _ap_unapplied_payments(d: Dataset) -> DataFrame:
    return ledger.open_balance(
        d.payments_ap(),
        d.payment_applications(),
        "payment_id",
        keep=(),
        names=("payment_amount", "applied_amount", "unapplied_amount"),
    )


@register("ap_unpaid_bills")
def _ap_unpaid_bills(d: Dataset) -> DataFrame:
    return ledger.unpaid_bills(d.bills(), d.payment_applications())


@register("ap_vendor_debt")
def _ap_vendor_debt(d: Dataset) -> DataFrame:
    return ledger.debt_by_party(d.bills(), d.payment_applications())


@register("ap_vendor_debt_as_of")
def _ap_vendor_debt_as_of(d: Dataset) -> DataFrame:
    return ledger.debt_as_of(d.vendors(), d.bills(), d.payment_applications(), P.AS_OF)


@register("ap_aging")
def _ap_aging(d: Dataset) -> DataFrame:
    return ledger.aging(d.vendors(), d.bills(), d.payment_applications(), P.AS_OF)


# ---- matching (accounts receivable) -----------------------------------------------
def _ar(d: Dataset) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    return d.match_inputs()


@register("ar_invoice_list")
def _ar_invoice_list(d: Dataset) -> DataFrame:
    return matching.invoice_list(d.invoices())


@register("ar_matching")
def _ar_matching(d: Dataset) -> DataFrame:
    return matching.match(*_ar(d))


@register("ar_unallocated_payments")
def _ar_unallocated_payments(d: Dataset) -> DataFrame:
    return matching.unallocated(d.payments(), d.cash_applications())


@register("ar_paid_before_invoice")
def _ar_paid_before_invoice(d: Dataset) -> DataFrame:
    return matching.paid_before_issue(*_ar(d))


@register("ar_days_to_pay")
def _ar_days_to_pay(d: Dataset) -> DataFrame:
    return matching.days_to_pay(*_ar(d))


@register("ar_avg_days_to_pay")
def _ar_avg_days_to_pay(d: Dataset) -> DataFrame:
    return matching.avg_days_to_pay(*_ar(d))


@register("ar_timeliness")
def _ar_timeliness(d: Dataset) -> DataFrame:
    return matching.timeliness(*_ar(d))


@register("ar_timeliness_summary")
def _ar_timeliness_summary(d: Dataset) -> DataFrame:
    return matching.timeliness_summary(*_ar(d))


@register("ar_timeliness_by_customer")
def _ar_timeliness_by_customer(d: Dataset) -> DataFrame:
    return matching.timeliness_by_customer(*_ar(d), d.customer_names())


@register("ar_slowest_paid")
def _ar_slowest_paid(d: Dataset) -> DataFrame:
    return matching.slowest_paid(*_ar(d), d.customer_names())


# ---- recency, concentration, trailing windows ------------------------------------
@register("c1_multi_card_24h")
def _c1_multi_card_24h(d: Dataset) -> DataFrame:
    return recency.recent_activity(d.transactions())


@register("c1_multi_device_24h")
def _c1_multi_device_24h(d: Dataset) -> DataFrame:
    return recency.recent_distinct(d.transactions(), "device_id", 24, 2, name="devices_last_24h")


@register("c1_chargeback_burst")
def _c1_chargeback_burst(d: Dataset) -> DataFrame:
    tx = d.transactions()
    return trailing.consecutive_gap(tx.filter(F.col("tx_type") == activity.CHARGEBACK), 48)


@register("c1_card_testing")
def _c1_card_testing(d: Dataset) -> DataFrame:
    small = trailing.small_purchases(d.transactions())
    return trailing.trailing_count(small, "1 hour", 5, name="purchases_in_1h")


@register("c1_multi_country_24h")
def _c1_multi_country_24h(d: Dataset) -> DataFrame:
    return trailing.trailing_distinct(d.transactions(), "country", "24 hours", 2, name="countries_in_24h", n=10)


@register("c2_velocity_24h")
def _c2_velocity_24h(d: Dataset) -> DataFrame:
    return recency.recent_count(d.transactions(), 24, name="tx_24h")


@register("c2_multi_device_24h")
def _c2_multi_device_24h(d: Dataset) -> DataFrame:
    return recency.recent_distinct(d.transactions(), "device_id", 24, 3, name="device_id_count")


@register("c2_multi_country_24h")
def _c2_multi_country_24h(d: Dataset) -> DataFrame:
    return recency.recent_distinct(d.transactions(), "country", 24, 2, name="distinct_country_count")


@register("c2_decline_storm")
def _c2_decline_storm(d: Dataset) -> DataFrame:
    declined = F.col("status") == activity.DECLINED
    return recency.recent_count(d.transactions(), 24, when=declined, min_count=5, name="declined_count")


@register("c2_merchant_concentration")
def _c2_merchant_concentration(d: Dataset) -> DataFrame:
    return concentration.concentration(d.transactions(), "merchant_id", 0.60, 10)


@register("c2_rapid_merchant_switch")
def _c2_rapid_merchant_switch(d: Dataset) -> DataFrame:
    return trailing.trailing_distinct(
        d.transactions(),
        "merchant_id",
        "1 hour",
        4,
        name="merchants_1h",
        order_by_time_desc=True,
    )


# ---- schema and data-quality checks ------------------------------------------------
@register("c2_schema")
def _c2_schema(d: Dataset) -> DataFrame:
    return catalog.describe(d.transactions())


@register("dq_primary_key")
def _dq_primary_key(d: Dataset) -> DataFrame:
    return quality.duplicate_keys(d.raw("lineitem"), ["l_orderkey", "l_linenumber"])


NOT_NULL_TABLES = ("invoices", "payments", "cash_applications", "customers", "credit_notes", "write_offs")


@register("dq_not_null")
def _dq_not_null(d: Dataset) -> DataFrame:
    frames = {t: getattr(d, t)() for t in NOT_NULL_TABLES if t != "customers"} | {"customers": d.customer_names()}
    return reduce(DataFrame.unionByName, [quality.null_counts(frames[t], KEYS[t][1], table=t) for t in NOT_NULL_TABLES])


@register("dq_foreign_key")
def _dq_foreign_key(d: Dataset) -> DataFrame:
    """Credit notes of invoices that do not exist (a declared reference)."""
    return quality.orphans(d.credit_notes(), d.invoices(), "invoice_id")


@register("dq_declared")
def _dq_declared(d: Dataset) -> DataFrame:
    """All declared keys, required columns and references of the receivables tables."""
    return quality.constraint_violations({t: d.customer_names() if t == "customers" else getattr(d, t)() for t in KEYS})
