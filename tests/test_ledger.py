"""Ledger reports: applied totals, as-of limits, aging buckets."""

from __future__ import annotations

import pytest
from conftest import d, m, rows

from paylens.operators import ledger
from paylens.sources import schemas

AS_OF = "2025-02-28"


@pytest.fixture(scope="module")
def ap(spark):
    bills = spark.createDataFrame(
        [
            (1, 10, m("100.00"), d("2025-02-28")),  # settled on time: 0 days
            (1, 11, m("100.00"), d("2025-01-29")),  # 30 days, partly paid
            (1, 12, m("100.00"), d("2025-01-28")),  # 31 days, unpaid
            (2, 20, m("50.00"), d("2024-12-30")),  # 60 days, overpaid
            (2, 21, m("70.00"), d("2024-12-29")),  # 61 days, paid only after as_of
            (2, 22, m("40.00"), d("2025-03-01")),  # not yet due (-1 day)
            (3, 30, m("30.00"), None),  # no due date
            (3, 31, m("25.00"), d("2025-01-01")),  # payment with no date
            (9, 90, m("10.00"), d("2025-01-01")),  # vendor not in the vendor table
        ],
        schemas.BILLS,
    )
    apps = spark.createDataFrame(
        [
            (10, 100, m("60.00"), d("2025-02-01")),
            (10, 101, m("40.00"), d("2025-02-10")),
            (11, 100, m("30.00"), d("2025-02-01")),
            (20, 102, m("80.00"), d("2025-01-15")),
            (21, 103, m("70.00"), d("2025-03-05")),
            (31, 104, m("5.00"), None),
            (77, 105, m("9.00"), d("2025-01-01")),  # bill that does not exist
        ],
        schemas.PAYMENT_APPLICATIONS,
    )
    vendors = spark.createDataFrame([(1,), (2,), (3,), (4,)], schemas.VENDORS)
    payments = spark.createDataFrame(
        [(100, m("90.00")), (101, m("40.00")), (106, m("15.00"))], schemas.PAYMENTS_AP
    )
    return bills, apps, vendors, payments


def test_open_balance(ap):
    bills, apps, _, _ = ap
    got = {r[1]: r[2:] for r in rows(ledger.open_balance(bills, apps))}
    assert got[10] == (m("100.00"), m("100.00"), m("0.00"))
    assert got[11] == (m("100.00"), m("30.00"), m("70.00"))
    assert got[12] == (m("100.00"), m("0.00"), m("100.00"))
    assert got[20] == (m("50.00"), m("80.00"), m("-30.00"))
    assert len(got) == 9


def test_unapplied_payments_lists_fully_applied(ap):
    _, apps, _, payments = ap
    out = ledger.open_balance(payments, apps, "payment_id", keep=(), names=("payment_amount", "applied_amount", "unapplied_amount"))
    assert rows(out) == [
        (100, m("90.00"), m("90.00"), m("0.00")),
        (101, m("40.00"), m("40.00"), m("0.00")),
        (106, m("15.00"), m("0.00"), m("15.00")),
    ]


def test_unpaid_bills_drop_settled_and_overpaid(ap):
    bills, apps, _, _ = ap
    assert [r[0] for r in rows(ledger.unpaid_bills(bills, apps), "bill_id")] == [11, 12, 22, 30, 31, 90]


def test_vendor_debt_nets_overpayments(ap):
    bills, apps, _, _ = ap
    assert rows(ledger.debt_by_party(bills, apps)) == [
        (1, m("170.00")),
        (2, m("10.00")),  # -30 + 0 (70 paid) + 40
        (3, m("50.00")),  # 30 + (25 - 5)
        (9, m("10.00")),
    ]


def test_debt_as_of_limits_applications_only(ap):
    bills, apps, vendors, _ = ap
    out = ledger.debt_as_of(vendors, bills, apps, AS_OF)
    assert out.columns == ["vendor_id", "debt_as_of_2025_02_28"]
    # bill 21 is paid after the date; the undated application of bill 31 is unpaid
    assert rows(out) == [(1, m("170.00")), (2, m("80.00")), (3, m("55.00")), (4, m("0.00"))]


def test_aging_buckets(ap):
    bills, apps, vendors, _ = ap
    got = rows(ledger.aging(vendors, bills, apps, AS_OF))
    assert got == [
        # total, 0-30, 31-60, 61+
        (1, m("170.00"), m("70.00"), m("100.00"), m("0.00")),  # 10 settled (0 days), 11 at 30, 12 at 31
        (2, m("80.00"), m("0.00"), m("0.00"), m("70.00")),  # 20 overpaid, 21 at 61, 22 not due
        (3, m("55.00"), m("0.00"), m("25.00"), m("0.00")),  # 30 has no due date, 31 at 58 days
        (4, m("0.00"), m("0.00"), m("0.00"), m("0.00")),
    ]


def test_aging_bucket_edges_with_open_balances(spark):
    bills = spark.createDataFrame(
        [
            (5, 50, m("10.00"), d("2025-02-28")),  # 0 days: current
            (5, 51, m("20.00"), d("2024-12-30")),  # 60 days: 31-60
            (5, 52, m("40.00"), d("2025-03-01")),  # -1 day: total only
        ],
        schemas.BILLS,
    )
    apps = spark.createDataFrame([], schemas.PAYMENT_APPLICATIONS)
    vendors = spark.createDataFrame([(5,)], schemas.VENDORS)
    assert rows(ledger.aging(vendors, bills, apps, AS_OF)) == [(5, m("70.00"), m("10.00"), m("20.00"), m("0.00"))]


def test_a_party_listed_twice_is_one_row_with_its_debt_counted_twice(spark):
    vendors = spark.createDataFrame([(1,), (1,), (2,), (3,)], "vendor_id bigint")
    bills = spark.createDataFrame(
        [(1, 10, m("100.00"), d("2025-01-15")), (2, 20, m("50.00"), d("2025-02-10"))],
        "vendor_id bigint, bill_id bigint, amount decimal(18,2), due_date date",
    )
    apps = spark.createDataFrame([(10, m("30.00"), d("2025-01-20"))], "bill_id bigint, applied_amount decimal(18,2), applied_date date")
    want = {1: m("140.00"), 2: m("50.00"), 3: m("0.00")}
    assert dict(rows(ledger.debt_as_of(vendors, bills, apps, column="debt"))) == want
    aged = rows(ledger.aging(vendors, bills, apps), "vendor_id", "total_debt", "overdue_31_60")
    assert aged == [(1, m("140.00"), m("140.00")), (2, m("50.00"), m("0.00")), (3, m("0.00"), m("0.00"))]


def test_repeated_bills_equal_the_raw_joins(spark):
    """Bills listed twice, with another amount, vendor or due date, without a key; all six reports."""
    bills = [
        (1, 10, m("100.00"), d("2025-02-20")), (1, 10, m("100.00"), d("2025-02-20")), (1, 10, m("70.00"), d("2025-01-10")),
        (2, 10, m("100.00"), d("2024-11-20")), (1, 11, m("50.00"), d("2025-01-15")), (2, 20, m("80.00"), None), (2, 20, m("80.00"), d("2024-12-01")),
        (2, None, m("5.00"), d("2025-01-01")), (2, None, m("5.00"), d("2025-01-01")), (3, 30, None, d("2025-01-01")), (None, 31, m("9.00"), d("2025-02-01")),
    ]
    apps = [(10, 100, m("30.00"), d("2025-01-20")), (10, 100, m("5.00"), d("2025-03-20")), (11, 101, m("60.00"), d("2025-01-20")), (20, 101, m("1.00"), None), (30, 102, m("2.00"), d("2025-01-01"))]
    vendors, payments = [(1,), (1,), (2,), (3,), (4,), (None,)], [(100, m("40.00")), (100, m("40.00")), (100, m("41.00")), (103, m("7.00"))]
    b, a = spark.createDataFrame(bills, schemas.BILLS), spark.createDataFrame(apps, schemas.PAYMENT_APPLICATIONS)
    v, p = spark.createDataFrame(vendors, schemas.VENDORS), spark.createDataFrame(payments, schemas.PAYMENTS_AP)
    for name, df in (("raw_b", b), ("raw_a", a), ("raw_v", v), ("raw_p", p)):
        df.createOrReplaceTempView(name)

    def same(df, sql):
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, map(tuple, spark.sql(sql).collect())))

    used = "CAST(coalesce(sum(raw_a.applied_amount), 0) AS DECIMAL(38,2))"
    same(
        ledger.open_balance(b, a),
        f"SELECT vendor_id, bill_id, amount, {used}, CAST(amount - {used} AS DECIMAL(38,2)) FROM raw_b LEFT JOIN raw_a USING (bill_id) GROUP BY vendor_id, bill_id, amount",
    )
    same(
        ledger.open_balance(p, a, "payment_id", keep=(), names=("x", "y", "z")),
        f"SELECT payment_id, amount, {used}, CAST(amount - {used} AS DECIMAL(38,2)) FROM raw_p LEFT JOIN raw_a USING (payment_id) GROUP BY payment_id, amount",
    )
    same(
        ledger.unpaid_bills(b, a),
        f"SELECT bill_id, amount, {used}, CAST(amount - {used} AS DECIMAL(38,2)) AS rest FROM raw_b LEFT JOIN raw_a USING (bill_id) GROUP BY bill_id, amount HAVING rest > 0",
    )
    same(
        ledger.debt_by_party(b, a),
        """SELECT vendor_id, CAST(sum(amount - coalesce(paid, 0)) AS DECIMAL(38,2)) FROM raw_b
           LEFT JOIN (SELECT bill_id, sum(applied_amount) AS paid FROM raw_a GROUP BY bill_id) USING (bill_id) GROUP BY vendor_id""",
    )

    def owed(extra):
        return f"""(SELECT raw_b.bill_id, {extra} raw_b.amount - coalesce(sum(applied_amount), 0) AS rest FROM raw_b
          LEFT JOIN raw_a ON raw_a.bill_id = raw_b.bill_id AND applied_date <= DATE'{AS_OF}' GROUP BY raw_b.bill_id, {extra} raw_b.amount) o"""

    same(
        ledger.debt_as_of(v, b, a, AS_OF),
        f"""SELECT raw_v.vendor_id, CAST(coalesce(sum(rest), 0) AS DECIMAL(38,2)) FROM raw_v LEFT JOIN raw_b ON raw_b.vendor_id = raw_v.vendor_id
            LEFT JOIN {owed('')} ON o.bill_id = raw_b.bill_id GROUP BY raw_v.vendor_id""",
    )
    late = f"datediff(DATE'{AS_OF}', o.due_date)"
    parts = ", ".join(
        f"CAST(sum(CASE WHEN rest > 0 AND {late} BETWEEN {lo} AND {hi} THEN rest ELSE 0 END) AS DECIMAL(38,2))" for lo, hi in ((0, 30), (31, 60), (61, 10**6))
    )
    same(
        ledger.aging(v, b, a, AS_OF),
        f"""SELECT raw_v.vendor_id, CAST(coalesce(sum(rest), 0) AS DECIMAL(38,2)), {parts} FROM raw_v LEFT JOIN raw_b ON raw_b.vendor_id = raw_v.vendor_id
            LEFT JOIN {owed('raw_b.due_date,')} ON o.bill_id = raw_b.bill_id GROUP BY raw_v.vendor_id""",
    )
