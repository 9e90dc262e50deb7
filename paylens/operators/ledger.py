"""Accounts-payable ledger reports: open balances, debt per party, as-of debt, aging.

Plan shape shared by all reports: applications are aggregated per document
key first (partial aggregation in the scan tasks, so a document with very
many applications is one row before any join), then left-joined to the
documents on that key. Per-party totals are one more partial+final aggregate.
An as-of date limits the *applications* before the join (a bill issued after
the date still counts as debt; a null application date counts as unpaid).

These forms equal the source analyses' raw left-join-then-group queries, also where
document keys repeat: equal documents (the key and what the analysis groups by) are one
row with the number of their listings, and each listing has drawn the applications
once. A party listed several times is one row whose debt counts once per listing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.exprs import MONEY_SUM, sum_money

# ---- fixed values: aging buckets of the source report (days past due) ----
DEFAULT_AGING_BUCKETS: tuple[tuple[str, int, int | None], ...] = (
    ("current_0_30", 0, 30),
    ("overdue_31_60", 31, 60),
    ("overdue_61_plus", 61, None),
)
DEFAULT_AS_OF = "2025-02-28"
#: Numbers of listings, as factors of money.
TIMES = "decimal(10,0)"


def _applied_per_key(apps: DataFrame, key: str, applied: str, as_of: str | None = None, date_col: str = "applied_date") -> DataFrame:
    if as_of is not None:
        apps = apps.filter(F.col(date_col) <= F.lit(_to_date(as_of)))
    return apps.groupBy(key).agg(F.sum(applied).alias("_applied"))


def _to_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def _with_applied(docs: DataFrame, apps: DataFrame, key: str, applied: str, amount: str, by: tuple[str, ...], as_of: str | None = None) -> DataFrame:
    """Documents listed several times as one row: ``by``, the key, the amount, ``_times``
    (listings), ``_once`` (the applied total) and ``_drawn``, what the raw join sums up: the
    applied total once for each listing."""
    listed = docs.groupBy(*dict.fromkeys((*by, key, amount))).agg(F.count(F.lit(1)).cast(TIMES).alias("_times"))
    per_key = _applied_per_key(apps, key, applied, as_of)
    once = F.coalesce(F.col("_applied"), F.lit(0)).cast(MONEY_SUM)
    joined = listed.join(per_key, key, "left").withColumn("_once", once).drop("_applied")
    return joined.withColumn("_drawn", (F.col("_once") * F.col("_times")).cast(MONEY_SUM))


def open_balance(
    docs: DataFrame,
    apps: DataFrame,
    key: str = "bill_id",
    *,
    amount: str = "amount",
    applied: str = "applied_amount",
    keep: tuple[str, ...] = ("vendor_id",),
    names: tuple[str, str, str] = ("bill_amount", "applied_amount", "open_balance"),
    ordered: bool = True,
) -> DataFrame:
    """Per document: amount, applied total (0 if none) and the remainder.

    Bills: ``open_balance(bills, apps)``; payments:
    ``open_balance(payments, apps, "payment_id", keep=(), names=("payment_amount",
    "applied_amount", "unapplied_amount"))``. No filter: settled and overpaid
    documents are listed too. Documents equal in ``keep``, key and amount are one row
    with the applied total once for each listing.
    """
    amount_name, applied_name, rest_name = names
    out = _with_applied(docs, apps, key, applied, amount, keep).select(
        *keep,
        key,
        F.col(amount).alias(amount_name),
        F.col("_drawn").alias(applied_name),
        (F.col(amount) - F.col("_drawn")).cast(MONEY_SUM).alias(rest_name),
    )
    return out.orderBy(key) if ordered else out


def unpaid_bills(bills: DataFrame, apps: DataFrame, *, key: str = "bill_id", ordered: bool = True) -> DataFrame:
    """Bills whose remaining balance is > 0 (settled and overpaid bills drop out)."""
    out = open_balance(
        bills, apps, key, keep=(), names=("bill_amount", "applied_amount", "unpaid_balance"), ordered=False
    ).filter(F.col("unpaid_balance") > 0)
    return out.orderBy(key) if ordered else out


def debt_by_party(
    bills: DataFrame,
    apps: DataFrame,
    *,
    party: str = "vendor_id",
    key: str = "bill_id",
    amount: str = "amount",
    applied: str = "applied_amount",
    ordered: bool = True,
) -> DataFrame:
    """Sum of remaining balances per party that has bills; overpayments net off."""
    per_key = _applied_per_key(apps, key, applied)
    rest = F.col(amount) - F.coalesce(F.col("_applied"), F.lit(0))
    out = bills.join(per_key, key, "left").groupBy(party).agg(sum_money(rest).alias("remaining_debt"))
    return out.orderBy(party) if ordered else out


def _debt_per_listing(
    bills: DataFrame, apps: DataFrame, as_of: str, party: str, key: str, amount: str, applied: str, extra: tuple[str, ...], parts: dict[str, str]
) -> DataFrame:
    """(party, _times, and a debt column for each of ``parts``): what one listing of a bill
    adds to its party at ``as_of``, and how many listings there are.

    The source joins every listing of a bill id to one debt row for each distinct
    (id, amount, ``extra``), and each such row has drawn the applications once for each of
    its own listings. ``parts`` are conditions on ``_rest``, the remaining amount of such
    a debt row. Everything about a bill id is in one partition after the join.
    """
    # a bill without a key can never be matched to its own debt row
    known = bills.filter(F.col(key).isNotNull())
    listed = _with_applied(known, apps, key, applied, amount, (party, *extra), as_of)
    row = ", ".join(f"`{c}`" for c in (key, amount, *extra))
    debts = listed.selectExpr(
        "*",
        f"CAST(`{amount}` - _once * sum(_times) OVER (PARTITION BY {row}) AS DECIMAL(38,2)) AS _rest",
        f"row_number() OVER (PARTITION BY {row} ORDER BY `{party}`) AS _nth",
    )
    sums = [f"sum(CASE WHEN _nth = 1 AND ({cond}) THEN _rest END) OVER (PARTITION BY `{key}`) AS `{name}`" for name, cond in parts.items()]
    return debts.selectExpr(f"`{party}`", "_times", *sums)


def _listed(parties: DataFrame, party: str) -> DataFrame:
    """Each party once, with how often it is listed (a partial count)."""
    return parties.groupBy(party).agg(F.count(F.lit(1)).cast(TIMES).alias("_listed"))


def debt_as_of(
    parties: DataFrame,
    bills: DataFrame,
    apps: DataFrame,
    as_of: str = DEFAULT_AS_OF,
    *,
    party: str = "vendor_id",
    key: str = "bill_id",
    amount: str = "amount",
    applied: str = "applied_amount",
    column: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Remaining debt per party at a date; parties without bills show 0.

    The output column is ``debt_as_of_<yyyy_mm_dd>`` unless ``column`` is given.
    """
    column = column or "debt_as_of_" + str(_to_date(as_of)).replace("-", "_")
    per_listing = _debt_per_listing(bills, apps, as_of, party, key, amount, applied, (), {"_owed": "true"})
    per_party = per_listing.groupBy(party).agg(F.sum(F.col("_owed") * F.col("_times")).alias("_debt"))
    out = _listed(parties, party).join(per_party, party, "left").select(
        party, (F.coalesce(F.col("_debt"), F.lit(0)) * F.col("_listed")).cast(MONEY_SUM).alias(column)
    )
    return out.orderBy(party) if ordered else out


def aging(
    parties: DataFrame,
    bills: DataFrame,
    apps: DataFrame,
    as_of: str = DEFAULT_AS_OF,
    buckets: tuple[tuple[str, int, int | None], ...] = DEFAULT_AGING_BUCKETS,
    *,
    party: str = "vendor_id",
    key: str = "bill_id",
    amount: str = "amount",
    applied: str = "applied_amount",
    due: str = "due_date",
    ordered: bool = True,
) -> DataFrame:
    """Total remaining debt per party and its split by whole days past due at ``as_of``.

    A bucket holds bills with remaining > 0 whose days past due lie in
    [lo, hi] (hi None = open). The buckets do not add up to the total: bills
    not yet due, overpaid bills and bills without a due date count in the
    total only.
    """
    days = f"datediff(DATE'{_to_date(as_of)}', `{due}`)"
    parts = {"total_debt": "true"}
    for name, lo, hi in buckets:
        parts[name] = f"_rest > 0 AND {days} >= {lo}" + ("" if hi is None else f" AND {days} <= {hi}")
    per_listing = _debt_per_listing(bills, apps, as_of, party, key, amount, applied, (due,), parts)
    per_party = per_listing.groupBy(party).agg(*[F.expr(f"sum(`{n}` * _times)").alias(n) for n in parts])
    names = ["total_debt"] + [b[0] for b in buckets]
    out = _listed(parties, party).join(per_party, party, "left").selectExpr(
        f"`{party}`", *[f"CAST(coalesce(`{n}`, 0) * _listed AS DECIMAL(38,2)) AS `{n}`" for n in names]
    )
    return out.orderBy(party) if ordered else out
