"""Cross-operator invariants on the driver's sf0.01 tables."""

from __future__ import annotations

import os

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from paylens.operators import ledger, matching, trailing
from paylens.sources.adapters import Dataset

SF = f"{TESTDATA}/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def data(spark):
    return Dataset(spark, SF)


def test_open_balances_sum_to_vendor_debt(data):
    bills, apps = data.bills(), data.payment_applications()
    total_open = rows(ledger.open_balance(bills, apps).agg(F.sum("open_balance")))[0][0]
    total_debt = rows(ledger.debt_by_party(bills, apps).agg(F.sum("remaining_debt")))[0][0]
    assert total_open == total_debt


def test_aging_total_equals_debt_as_of(data):
    as_of = "1998-06-30"
    a = ledger.aging(data.vendors(), data.bills(), data.payment_applications(), as_of, ordered=False)
    b = ledger.debt_as_of(data.vendors(), data.bills(), data.payment_applications(), as_of, column="d", ordered=False)
    diff = a.join(b, "vendor_id").filter(F.col("total_debt") != F.col("d"))
    assert diff.count() == 0
    # buckets never exceed the positive part of the debt
    over = a.filter(F.col("current_0_30") + F.col("overdue_31_60") + F.col("overdue_61_plus") < 0)
    assert over.count() == 0


def test_late_plus_on_time_equals_applications(data):
    inv, apps, pay = data.invoices(), data.cash_applications(), data.payments()
    summary = dict(rows(matching.timeliness_summary(inv, apps, pay)))
    assert summary["LATE"] + summary["ON_TIME"] == matching.match(inv, apps, pay).count()
    by_customer = rows(matching.timeliness_by_customer(inv, apps, pay, data.customers()).agg(F.sum("payment_count")))
    assert by_customer[0][0] == summary["LATE"] + summary["ON_TIME"]


@pytest.mark.parametrize("bucket_rows", [1_000_000, 20])
def test_trailing_strategies_agree_on_events(data, bucket_rows):
    tx = data.transactions()
    a = trailing.trailing_distinct(tx, "country", "24 hours", 1, name="n", strategy="window", ordered=False)
    b = trailing.trailing_distinct(tx, "country", "24 hours", 1, name="n", bucket_rows=bucket_rows, ordered=False)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    c = trailing.trailing_count(tx, "1 hour", 1, name="n", strategy="window", ordered=False)
    e = trailing.trailing_count(tx, "1 hour", 1, name="n", bucket_rows=bucket_rows, ordered=False)
    assert c.exceptAll(e).count() == 0 and e.exceptAll(c).count() == 0


def test_sql_over_registered_views_matches_operator(spark, data):
    data.register_views()
    # every bill once, every application once with its sign, one sum per bill
    sql = """
    SELECT max(vendor_id) AS vendor_id, bill_id, max(billed) AS bill_amount, CAST(sum(used) AS DECIMAL(38,2)) AS applied_amount,
      CAST(sum(coalesce(billed, 0) - used) AS DECIMAL(38,2)) AS open_balance
    FROM (SELECT vendor_id, bill_id, amount AS billed, 0 AS used FROM bills
          UNION ALL SELECT NULL, bill_id, NULL, applied_amount FROM payment_applications)
    GROUP BY bill_id HAVING max(billed) IS NOT NULL
    """
    via_sql = spark.sql(sql)
    via_op = ledger.open_balance(data.bills(), data.payment_applications(), ordered=False)
    assert via_sql.exceptAll(via_op).count() == 0 and via_op.exceptAll(via_sql).count() == 0


def test_adapted_receivables_meet_their_declared_constraints(data):
    from paylens.operators import quality

    tables = {
        "customers": data.customers(),
        "invoices": data.invoices(),
        "payments": data.payments(),
        "cash_applications": data.cash_applications(),
    }
    got = rows(quality.constraint_violations(tables), "table_name", "check_name", "column_name", "violations")
    assert len(got) == 4 + (1 + 6 + 4 + 5) + (1 + 1 + 2)
    # lines repeat (order, line number), which the application ids are made of
    assert [r[:3] for r in got if r[3]] == [("cash_applications", "primary_key", "application_id")]
