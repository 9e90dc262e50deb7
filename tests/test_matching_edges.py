"""Receivables edge cases, and AQE skew handling of a hot join key."""

from __future__ import annotations

from conftest import d, m, rows
from pyspark.sql import functions as F

from paylens.operators import matching, recency
from paylens.plans.explain import plan_text
from paylens.sources import schemas


def _tables(spark):
    customers = spark.createDataFrame(
        [(1, "Same Name Ltd", None, None, None), (2, "Same Name Ltd", None, None, None), (3, "Other", None, None, None)],
        schemas.CUSTOMERS,
    )
    invoices = spark.createDataFrame(
        [
            (10, 1, d("2025-01-01"), d("2025-01-31"), m("100.00"), "OPEN", None, None),
            (11, 2, d("2025-01-05"), d("2025-02-04"), m("50.00"), "OPEN", None, None),
            (12, 3, d("2025-01-10"), d("2025-02-09"), m("70.00"), "OPEN", None, None),
        ],
        schemas.INVOICES,
    )
    payments = spark.createDataFrame(
        [
            (20, 1, d("2025-01-31"), m("60.00"), None, "BANK", None),  # on the due date of 10
            (21, 1, d("2025-02-01"), m("40.00"), None, "BANK", None),  # one day late for 10
            (22, 2, d("2025-01-20"), m("120.00"), None, "BANK", None),  # split over 11 and 12
        ],
        schemas.PAYMENTS,
    )
    apps = spark.createDataFrame(
        [
            (1, 20, 10, m("60.00"), d("2025-01-31"), None),
            (2, 21, 10, m("40.00"), d("2025-02-01"), None),
            (3, 22, 11, m("50.00"), d("2025-01-20"), None),
            (4, 22, 12, m("70.00"), d("2025-01-20"), None),
        ],
        schemas.CASH_APPLICATIONS,
    )
    return customers, invoices, payments, apps


def test_two_payments_for_one_invoice_and_one_payment_for_two(spark):
    customers, invoices, payments, apps = _tables(spark)
    got = sorted(rows(matching.days_to_pay(invoices, apps, payments), "invoice_id", "days_to_pay"))
    assert got == [(10, 30), (10, 31), (11, 15), (12, 10)]  # one row per application
    assert rows(matching.avg_days_to_pay(invoices, apps, payments)) == [(21.5,)]


def test_due_date_payment_is_on_time_and_namesakes_merge(spark):
    customers, invoices, payments, apps = _tables(spark)
    status = dict(((r[0], r[1]), r[2]) for r in rows(matching.timeliness(invoices, apps, payments), "invoice_id", "payment_date", "payment_status"))
    assert status[(10, d("2025-01-31"))] == "ON_TIME"
    assert status[(10, d("2025-02-01"))] == "LATE"
    got = rows(matching.timeliness_by_customer(invoices, apps, payments, customers))
    assert got == [("Other", "ON_TIME", 1), ("Same Name Ltd", "ON_TIME", 2), ("Same Name Ltd", "LATE", 1)]


def test_partly_applied_payment_is_not_unallocated(spark):
    customers, invoices, payments, apps = _tables(spark)
    extra = spark.createDataFrame([(23, 3, d("2025-03-01"), m("5.00"), "x", "CASH", None)], schemas.PAYMENTS)
    got = rows(matching.unallocated(payments.unionByName(extra), apps), "payment_id")
    assert got == [(23,)]


def test_hot_user_join_partition_is_split_by_aqe(spark):
    """Recency joins rows to each user's latest time; a user with most of the
    rows makes one join partition huge. With a sort-merge join AQE splits it."""
    n = 20000
    tx = spark.range(n).select(
        F.when(F.col("id") % 10 < 7, F.lit(1)).otherwise(F.col("id") % 97).cast("bigint").alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).cast("timestamp_ntz").alias("transaction_time"),
        (F.col("id") % 5).cast("string").alias("device_id"),
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        skewed = recency.recent_count(tx, 24, name="n", ordered=False)
        text = plan_text(skewed, final=True)
        got = sorted(rows(skewed), key=repr)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in text and "AQEShuffleRead skewed" in text
    assert got == sorted(rows(recency.recent_count(tx, 24, name="n", ordered=False)), key=repr)
