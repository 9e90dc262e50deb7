"""Receivables operators on the seed rows; expected values derived by hand."""

from __future__ import annotations

from conftest import d, rows

from paylens.operators import matching, quality


def _ar(seed):
    return seed["invoices"], seed["cash_applications"], seed["payments"]


def test_invoice_list_order(seed):
    got = [r[0] for r in rows(matching.invoice_list(seed["invoices"]), "invoice_id")]
    # 1002 and 1004 have distinct dates; order is by invoice_date only
    assert got == [1001, 1002, 1003, 1005, 1004, 1009, 1007, 1010, 1008, 1006]


def test_matching(seed):
    got = sorted(rows(matching.match(*_ar(seed)), "invoice_id", "invoice_date", "payment_id", "payment_date"))
    assert got == [
        (1001, d("2025-10-05"), 2001, d("2025-10-20")),
        (1002, d("2025-10-28"), 2002, d("2025-11-15")),
        (1003, d("2025-11-03"), 2003, d("2025-12-10")),
        (1005, d("2025-11-15"), 2004, d("2025-12-05")),
    ]


def test_unallocated_payments(seed):
    got = rows(matching.unallocated(seed["payments"], seed["cash_applications"]), "payment_id", "reference")
    assert got == [(2006, "MIXED"), (2005, "")]


def test_paid_before_invoice_is_empty(seed):
    assert matching.paid_before_issue(*_ar(seed)).count() == 0


def test_days_to_pay(seed):
    got = rows(matching.days_to_pay(*_ar(seed)), "invoice_id", "days_to_pay")
    assert got == [(1003, 37), (1005, 20), (1002, 18), (1001, 15)]


def test_avg_days_to_pay(seed):
    assert rows(matching.avg_days_to_pay(*_ar(seed))) == [(22.5,)]


def test_timeliness(seed):
    got = rows(matching.timeliness(*_ar(seed)), "invoice_id", "payment_status")
    assert got == [(1001, "ON_TIME"), (1002, "ON_TIME"), (1003, "LATE"), (1005, "ON_TIME")]


def test_timeliness_summary(seed):
    assert sorted(rows(matching.timeliness_summary(*_ar(seed)))) == [("LATE", 1), ("ON_TIME", 3)]


def test_timeliness_by_customer(seed):
    got = rows(matching.timeliness_by_customer(*_ar(seed), seed["customers"]))
    assert got == [
        ("Alfa Retail s.r.o.", "ON_TIME", 2),
        ("Beta Distribution a.s.", "LATE", 1),
        ("Gamma Services GmbH", "ON_TIME", 1),
    ]


def test_slowest_paid_has_only_four_rows(seed):
    got = rows(matching.slowest_paid(*_ar(seed), seed["customers"]), "invoice_id", "days_to_pay")
    assert got == [(1003, 37), (1005, 20), (1002, 18), (1001, 15)]


def test_declared_constraints_hold_on_seed(seed):
    v = rows(quality.constraint_violations(seed), "table_name", "check_name", "column_name", "violations")
    assert len(v) == 6 + 24 + 6  # six key checks, 24 required columns, six foreign keys
    assert all(r[3] == 0 for r in v), [r for r in v if r[3]]
