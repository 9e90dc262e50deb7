from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paylens.session import build_session  # noqa: E402
from paylens.sources import schemas  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[*]", app_name="paylens-tests", shuffle_partitions=8)
    yield s
    s.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def m(text: str) -> Decimal:
    return Decimal(text)


# ---- fixed values: the receivables seed rows of the source analysis ----
SEED_CUSTOMERS = [
    (1, "Alfa Retail s.r.o.", "Retail", "CZ", d("2024-01-10")),
    (2, "Beta Distribution a.s.", "Distributor", "CZ", d("2023-05-02")),
    (3, "Gamma Services GmbH", "Services", "DE", d("2024-09-12")),
    (4, "Delta Partners s.r.o.", "SMB", "CZ", d("2025-11-20")),
    (5, "Epsilon Trading Ltd.", "SMB", "UK", d("2025-12-05")),
]
SEED_INVOICES = [
    (1001, 1, d("2025-10-05"), d("2025-11-04"), m("12000.00"), "PAID", "eva", ts("2025-10-05 09:10:00")),
    (1002, 1, d("2025-10-28"), d("2025-11-27"), m("9500.00"), "PAID", "eva", ts("2025-10-28 16:40:00")),
    (1003, 2, d("2025-11-03"), d("2025-12-03"), m("78000.00"), "PARTIAL", "tom", ts("2025-11-03 10:05:00")),
    (1004, 2, d("2025-11-30"), d("2025-12-30"), m("150000.00"), "OPEN", "tom", ts("2025-11-30 23:15:00")),
    (1005, 3, d("2025-11-15"), d("2025-12-15"), m("34000.00"), "PAID", "eva", ts("2025-11-15 11:00:00")),
    (1006, 3, d("2025-12-31"), d("2026-01-30"), m("62000.00"), "OPEN", "tom", ts("2025-12-31 23:50:00")),
    (1007, 4, d("2025-12-20"), d("2026-01-19"), m("19999.99"), "OPEN", "tom", ts("2025-12-20 14:20:00")),
    (1008, 4, d("2025-12-29"), d("2026-01-28"), m("20000.00"), "OPEN", "tom", ts("2025-12-29 18:05:00")),
    (1009, 5, d("2025-12-10"), d("2026-01-09"), m("50000.00"), "OPEN", "tom", ts("2025-12-10 09:30:00")),
    (1010, 5, d("2025-12-27"), d("2026-01-26"), m("49999.00"), "CREDITED", "tom", ts("2025-12-27 19:55:00")),
]
SEED_PAYMENTS = [
    (2001, 1, d("2025-10-20"), m("12000.00"), "1001", "BANK", "anna"),
    (2002, 1, d("2025-11-15"), m("9500.00"), "INV-1002", "BANK", "anna"),
    (2003, 2, d("2025-12-10"), m("30000.00"), None, "BANK", "anna"),
    (2004, 3, d("2025-12-05"), m("34000.00"), "1005", "BANK", "anna"),
    (2005, 4, d("2025-12-29"), m("5000.00"), "", "CASH", "mark"),
    (2006, 5, d("2025-12-28"), m("10000.00"), "MIXED", "BANK", "anna"),
]
SEED_CASH_APPLICATIONS = [
    (3001, 2001, 1001, m("12000.00"), d("2025-10-20"), "anna"),
    (3002, 2002, 1002, m("9500.00"), d("2025-11-15"), "anna"),
    (3003, 2004, 1005, m("34000.00"), d("2025-12-05"), "anna"),
    (3004, 2003, 1003, m("30000.00"), d("2025-12-11"), "tom"),
]
SEED_CREDIT_NOTES = [(4001, 1010, d("2026-01-15"), m("49999.00"), "Return / cancellation", "tom")]
SEED_WRITE_OFFS = [(5001, 1003, d("2026-02-20"), m("15000.00"), "Bad debt partial", "manager1")]


@pytest.fixture(scope="session")
def seed(spark):
    mk = spark.createDataFrame
    return {
        "customers": mk(SEED_CUSTOMERS, schemas.CUSTOMERS),
        "invoices": mk(SEED_INVOICES, schemas.INVOICES),
        "payments": mk(SEED_PAYMENTS, schemas.PAYMENTS),
        "cash_applications": mk(SEED_CASH_APPLICATIONS, schemas.CASH_APPLICATIONS),
        "credit_notes": mk(SEED_CREDIT_NOTES, schemas.CREDIT_NOTES),
        "write_offs": mk(SEED_WRITE_OFFS, schemas.WRITE_OFFS),
    }


def rows(df, *cols):
    """Collected rows as tuples (optionally a subset of columns)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
