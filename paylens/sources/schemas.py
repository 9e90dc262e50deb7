"""Fixed schemas of the domain tables.

The receivables tables carry declared schemas (primary and foreign keys are
listed in ``KEYS`` and checked by ``operators.quality``; Spark does not enforce
them). The other tables have no declared schema in the source analyses; their
column sets are inferred from use and the types are our choice.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from paylens.functions.exprs import MONEY


def _s(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


# ---- fixed values: receivables (declared) -------------------------------------------------
CUSTOMERS = _s(
    ("customer_id", LongType(), False),
    ("customer_name", StringType(), True),
    ("segment", StringType(), True),
    ("country", StringType(), True),
    ("created_at", DateType(), True),
)
INVOICES = _s(
    ("invoice_id", LongType(), False),
    ("customer_id", LongType(), False),
    ("invoice_date", DateType(), False),
    ("due_date", DateType(), False),
    ("amount", MONEY, False),
    ("status", StringType(), False),
    ("created_by", StringType(), True),
    ("created_ts", TimestampNTZType(), True),
)
PAYMENTS = _s(
    ("payment_id", LongType(), False),
    ("customer_id", LongType(), False),
    ("payment_date", DateType(), False),
    ("amount", MONEY, False),
    ("reference", StringType(), True),
    ("method", StringType(), True),
    ("received_by", StringType(), True),
)
CASH_APPLICATIONS = _s(
    ("application_id", LongType(), False),
    ("payment_id", LongType(), False),
    ("invoice_id", LongType(), False),
    ("applied_amount", MONEY, False),
    ("applied_date", DateType(), False),
    ("applied_by", StringType(), True),
)
CREDIT_NOTES = _s(
    ("credit_note_id", LongType(), False),
    ("invoice_id", LongType(), False),
    ("credit_date", DateType(), False),
    ("amount", MONEY, False),
    ("reason", StringType(), True),
    ("created_by", StringType(), True),
)
WRITE_OFFS = _s(
    ("write_off_id", LongType(), False),
    ("invoice_id", LongType(), False),
    ("write_off_date", DateType(), False),
    ("amount", MONEY, False),
    ("reason", StringType(), True),
    ("approved_by", StringType(), True),
)

# ---- inferred from use ------------------------------------------------------
FRAUD_TRANSACTIONS = _s(
    ("user_id", LongType(), True),
    ("tx_type", StringType(), True),
    ("amount", MONEY, True),
    ("transaction_time", TimestampNTZType(), True),
    ("card_id", StringType(), True),
    ("device_id", StringType(), True),
    ("country", StringType(), True),
)
RISK_PAYMENTS = _s(
    ("transaction_id", LongType(), True),
    ("user_id", LongType(), True),
    ("transaction_time", TimestampNTZType(), True),
    ("amount", MONEY, True),
    ("merchant_id", StringType(), True),
    ("country", StringType(), True),
    ("ip_address", StringType(), True),
    ("device_id", StringType(), True),
    ("payment_method", StringType(), True),
    ("status", StringType(), True),
)
BILLS = _s(
    ("vendor_id", LongType(), True),
    ("bill_id", LongType(), True),
    ("amount", MONEY, True),
    ("due_date", DateType(), True),
)
PAYMENTS_AP = _s(("payment_id", LongType(), True), ("amount", MONEY, True))
PAYMENT_APPLICATIONS = _s(
    ("bill_id", LongType(), True),
    ("payment_id", LongType(), True),
    ("applied_amount", MONEY, True),
    ("applied_date", DateType(), True),
)
VENDORS = _s(("vendor_id", LongType(), True))

# ---- fixed values: declared keys of the receivables tables ---------------------------------
# table -> (primary key columns, not-null columns, [(fk column, parent, parent key)])
KEYS = {
    "customers": (["customer_id"], ["customer_id"], []),
    "invoices": (
        ["invoice_id"],
        ["invoice_id", "customer_id", "invoice_date", "due_date", "amount", "status"],
        [("customer_id", "customers", "customer_id")],
    ),
    "payments": (
        ["payment_id"],
        ["payment_id", "customer_id", "payment_date", "amount"],
        [("customer_id", "customers", "customer_id")],
    ),
    "cash_applications": (
        ["application_id"],
        ["application_id", "payment_id", "invoice_id", "applied_amount", "applied_date"],
        [("payment_id", "payments", "payment_id"), ("invoice_id", "invoices", "invoice_id")],
    ),
    "credit_notes": (
        ["credit_note_id"],
        ["credit_note_id", "invoice_id", "credit_date", "amount"],
        [("invoice_id", "invoices", "invoice_id")],
    ),
    "write_offs": (
        ["write_off_id"],
        ["write_off_id", "invoice_id", "write_off_date", "amount"],
        [("invoice_id", "invoices", "invoice_id")],
    ),
}
