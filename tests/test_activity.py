"""Activity aggregates: null-safe ratios, threshold strictness, empty input."""

from __future__ import annotations

from conftest import m, rows, ts

from paylens.operators import activity
from paylens.sources import schemas

T0 = ts("2024-01-01 00:00:00")


def _tx(spark, spec):
    """spec: list of (user, n_purchases, n_chargebacks, amount per purchase)."""
    out = []
    for user, n_p, n_cb, amt in spec:
        out += [(user, "purchase", m(amt), T0, "c", "d", "MT")] * n_p
        out += [(user, "chargeback", m("1.00"), T0, "c", "d", "MT")] * n_cb
    return spark.createDataFrame(out, schemas.FRAUD_TRANSACTIONS)


def test_zero_purchases_drop_out_of_every_ratio_list(spark):
    tx = _tx(spark, [(1, 0, 5, "1.00"), (2, 10, 1, "1.00")])
    assert [r[0] for r in rows(activity.chargeback_ratio(tx), "user_id")] == [2]
    assert rows(activity.high_risk_users(tx, 0, 0), "user_id") == [(2,)]
    assert rows(activity.risk_triage(tx, 1, 0), "user_id") == [(2,)]


def test_high_risk_thresholds_are_strict(spark):
    # user 1: exactly 20 purchases; user 2: 21 purchases and ratio exactly 3 %... not
    # representable with 21, so 100 purchases and 3 chargebacks = exactly 3 %
    tx = _tx(spark, [(1, 20, 5, "1.00"), (2, 100, 3, "1.00"), (3, 100, 4, "1.00")])
    assert rows(activity.high_risk_users(tx), "user_id") == [(3,)]


def test_triage_thresholds_inclusive_and_order(spark):
    tx = _tx(
        spark,
        [
            (1, 100, 2, "1.00"),  # exactly 2 chargebacks and 2 %: kept
            (2, 101, 2, "1.00"),  # 1.98 %: dropped
            (3, 50, 3, "5.00"),
            (4, 50, 3, "9.00"),  # same count and ratio as 3, larger volume first
            (5, 10, 1, "1.00"),  # one chargeback: dropped
        ],
    )
    got = rows(activity.risk_triage(tx), "user_id", "chargeback_count", "purchase_volume")
    assert got == [(4, 3, m("450.00")), (3, 3, m("250.00")), (1, 2, m("100.00"))]
    assert activity.risk_triage(tx, n=1).count() == 1


def test_ratio_percent_is_divide_then_multiply(spark):
    # 29 / 100 * 100 is 28.999999999999996 in doubles
    tx = _tx(spark, [(1, 100, 29, "1.00")])
    (pct,) = rows(activity.high_risk_users(tx, 0, 0), "chargeback_ratio_pct")[0]
    assert pct == 29 / 100 * 100


def test_fraud_overview_counts_all_types(spark):
    tx = _tx(spark, [(1, 2, 1, "3.50"), (2, 1, 0, "1.25")])
    assert rows(activity.fraud_overview(tx)) == [(m("9.25"), 2, 3, 1)]


def test_overview_on_empty_input(spark):
    tx = spark.createDataFrame([], schemas.RISK_PAYMENTS)
    # COUNT(*) and COUNT FILTER give 0, SUM(CASE ...) gives null
    assert rows(activity.payments_overview(tx)) == [(0, None, None, 0, 0, None, None)]
    assert rows(activity.fraud_overview(spark.createDataFrame([], schemas.FRAUD_TRANSACTIONS))) == [(None, 0, 0, 0)]


def _pay(spark, spec):
    out = []
    i = 0
    for user, n_ok, n_bad in spec:
        for status, n in (("approved", n_ok), ("declined", n_bad)):
            for _ in range(n):
                i += 1
                out.append((i, user, T0, m("2.00"), "m1", "MT", None, "d", "card", status))
    return spark.createDataFrame(out, schemas.RISK_PAYMENTS)


def test_high_decline_boundaries(spark):
    tx = _pay(spark, [(1, 6, 4), (2, 5, 5), (3, 4, 5)])  # 0.40 exactly, 0.5, 9 rows only
    assert rows(activity.high_decline(tx), "user_id", "total_tx", "declined_tx", "decline_rate") == [(2, 10, 5, 0.5)]


def test_user_behaviour_mean_and_null_status(spark):
    tx = _pay(spark, [(1, 2, 1)]).unionByName(
        spark.createDataFrame([(99, 1, T0, None, "m1", "MT", None, "d", "card", None)], schemas.RISK_PAYMENTS)
    )
    assert rows(activity.user_behaviour(tx)) == [(1, 4, 2, 1, m("6.00"), 2.0)]


def test_approximate_distinct_is_opt_in(spark):
    from pyspark.sql import functions as F

    tx = spark.range(20000).select(
        F.col("id").alias("transaction_id"), (F.col("id") % 5000).alias("user_id"),
        F.lit(None).cast("timestamp_ntz").alias("transaction_time"), F.lit(1).cast("decimal(18,2)").alias("amount"),
        (F.col("id") % 7).cast("string").alias("merchant_id"), F.lit("MT").alias("country"),
        F.lit(None).cast("string").alias("ip_address"), F.lit("d").alias("device_id"),
        F.lit("card").alias("payment_method"), F.lit("approved").alias("status"),
    )
    exact = rows(activity.payments_overview(tx), "unique_users", "unique_merchants")[0]
    approx = rows(activity.payments_overview(tx, approx_rsd=0.02), "unique_users", "unique_merchants")[0]
    assert exact == (5000, 7)
    assert abs(approx[0] - 5000) <= 5000 * 0.1 and approx[1] == 7
