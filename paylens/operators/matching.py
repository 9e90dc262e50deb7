"""Receivables reconciliation: invoice-to-payment matching and payment timing.

``matched`` is the core view, one row per cash application joined to its
invoice and its payment (two inner equi-joins). The other operators project
or aggregate it; Catalyst prunes the columns each one does not read. A hot
invoice or payment (many applications on one key) is a skewed join key, which
AQE's skew-join handling splits.

The reports take the three tables, or a stored match relation (``sources.stored``) as the
first argument and None for the others.

Rules kept from the source analyses:
* days to pay are whole days (payment date - invoice date), one row per
  application, not per invoice;
* LATE when payment date > due date, otherwise ON_TIME (paying on the due
  date, or a missing date, is ON_TIME);
* unallocated payments are payments with no application at all;
* per-customer counts group by customer *name*, so namesakes merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.exprs import days_between

LATE, ON_TIME = "LATE", "ON_TIME"


def matched(invoices: DataFrame, applications: DataFrame, payments: DataFrame) -> DataFrame:
    """Application rows with invoice and payment columns."""
    inv = invoices.select("invoice_id", "customer_id", "invoice_date", "due_date")
    app = applications.select("invoice_id", "payment_id", "applied_amount")
    pay = payments.select("payment_id", "payment_date")
    return inv.join(app, "invoice_id").join(pay, "payment_id")


def _matches(invoices: DataFrame, applications: DataFrame | None, payments: DataFrame | None) -> DataFrame:
    return invoices if applications is None else matched(invoices, applications, payments)


def payment_status(payment_date: str = "payment_date", due_date: str = "due_date") -> F.Column:
    return F.when(F.col(payment_date) > F.col(due_date), F.lit(LATE)).otherwise(F.lit(ON_TIME))


def invoice_list(invoices: DataFrame, *, ordered: bool = True) -> DataFrame:
    out = invoices.select("invoice_id", "invoice_date", "due_date", "amount", "status")
    return out.orderBy("invoice_date", "invoice_id") if ordered else out


def match(invoices: DataFrame, applications: DataFrame | None, payments: DataFrame | None, *, ordered: bool = True) -> DataFrame:
    out = _matches(invoices, applications, payments).select(
        "invoice_id", "invoice_date", "payment_id", "payment_date", "applied_amount"
    )
    return out.orderBy("invoice_date", "invoice_id", "payment_id") if ordered else out


def unallocated(payments: DataFrame, applications: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Payments with no application (anti join; partly applied payments are not listed)."""
    out = payments.join(applications.select("payment_id"), "payment_id", "left_anti").select(
        "payment_id", "customer_id", "payment_date", "amount", "reference", "method"
    )
    return out.orderBy(F.col("amount").desc(), F.col("payment_id").asc()) if ordered else out


def paid_before_issue(invoices: DataFrame, applications: DataFrame | None, payments: DataFrame | None, *, ordered: bool = True) -> DataFrame:
    out = match(invoices, applications, payments, ordered=False).filter(F.col("payment_date") < F.col("invoice_date"))
    return out.orderBy("payment_date", "invoice_id", "payment_id") if ordered else out


def days_to_pay(invoices: DataFrame, applications: DataFrame | None, payments: DataFrame | None, *, ordered: bool = True) -> DataFrame:
    out = _matches(invoices, applications, payments).select(
        "invoice_id",
        "invoice_date",
        "payment_date",
        days_between("payment_date", "invoice_date").alias("days_to_pay"),
    )
    return out.orderBy(F.col("days_to_pay").desc(), F.col("invoice_id").asc(), F.col("payment_date").asc()) if ordered else out


def avg_days_to_pay(invoices: DataFrame, applications: DataFrame | None, payments: DataFrame | None) -> DataFrame:
    """Mean days to pay over applications (not amount-weighted), rounded to 2 places."""
    days = days_between("payment_date", "invoice_date")
    return _matches(invoices, applications, payments).agg(F.round(F.avg(days), 2).alias("avg_days_to_pay"))


def timeliness(invoices: DataFrame, applications: DataFrame | None, payments: DataFrame | None, *, ordered: bool = True) -> DataFrame:
    out = _matches(invoices, applications, payments).select(
        "invoice_id", "due_date", "payment_date", payment_status().alias("payment_status")
    )
    return out.orderBy("invoice_id", "payment_date") if ordered else out


def timeliness_summary(invoices: DataFrame, applications: DataFrame | None, payments: DataFrame | None) -> DataFrame:
    return (
        _matches(invoices, applications, payments)
        .groupBy(payment_status().alias("payment_status"))
        .agg(F.count(F.lit(1)).alias("payment_count"))
    )


def timeliness_by_customer(
    invoices: DataFrame,
    applications: DataFrame | None,
    payments: DataFrame | None,
    customers: DataFrame,
    *,
    ordered: bool = True,
) -> DataFrame:
    """Counts per customer name and status.

    Counted per (customer_id, status) first, so the join to the customer
    names sees one row per customer and status instead of one per
    application; the second aggregate merges namesakes.
    """
    per_id = (
        _matches(invoices, applications, payments)
        .groupBy("customer_id", payment_status().alias("payment_status"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    names = customers.select("customer_id", "customer_name")
    out = (
        per_id.join(names, "customer_id")
        .groupBy("customer_name", "payment_status")
        .agg(F.sum("_n").alias("payment_count"))
    )
    return out.orderBy(F.col("customer_name").asc(), F.col("payment_count").desc(), F.col("payment_status").asc()) if ordered else out


def slowest_paid(
    invoices: DataFrame,
    applications: DataFrame | None,
    payments: DataFrame | None,
    customers: DataFrame,
    n: int = 5,
) -> DataFrame:
    """Top ``n`` applications by days to pay, with the customer name.

    Ties on days to pay are broken by invoice_id, then payment_id. The top rows are
    found among matches whose customer is known, by ids alone; only they are joined
    to names.
    """
    order = [F.col("days_to_pay").desc(), F.col("invoice_id").asc(), F.col("payment_id").asc()]
    top = (
        _matches(invoices, applications, payments)
        .join(customers.select("customer_id"), "customer_id", "left_semi")
        .withColumn("days_to_pay", days_between("payment_date", "invoice_date"))
        .orderBy(*order)
        .limit(n)
    )
    named = top.join(customers.select("customer_id", "customer_name"), "customer_id")
    return named.orderBy(*order).limit(n).select("invoice_id", "customer_name", "invoice_date", "payment_date", "days_to_pay")
