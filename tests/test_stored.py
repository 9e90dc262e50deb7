"""Bucketed tables, the stored match relation, batches loaded once, declared schemas."""

from __future__ import annotations

import os
import shutil

import pytest
from conftest import (
    SEED_CASH_APPLICATIONS, SEED_CREDIT_NOTES, SEED_CUSTOMERS, SEED_INVOICES, SEED_PAYMENTS, SEED_WRITE_OFFS, TESTDATA, rows,
)
from pyspark.sql import functions as F

from paylens.plans.explain import plan_text
from paylens.plans.registry import QUERIES, REPORTS
from paylens.sources import schemas, stored, tables
from paylens.sources.adapters import Dataset

SF = f"{TESTDATA}/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _same(a, b):
    return sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


@needs_data
def test_joins_of_bucketed_tables_need_no_exchange(spark, tmp_path, no_broadcast):
    prefix = f"b{os.getpid()}"
    d = stored.store_bucketed(Dataset(spark, SF), str(tmp_path / "t"), prefix, 4)
    try:
        for key in ("ap_open_balance", "ap_unpaid_bills", "ap_vendor_debt"):
            plan = plan_text(REPORTS[key](d))
            below = plan[plan.index("Join") :]
            assert "SortMergeJoin" in plan and "Exchange" not in below, key
            assert _same(REPORTS[key](d), QUERIES[key](spark, SF)), key
        pairs = d.invoices().join(d.cash_applications(), "invoice_id")
        assert "Exchange" not in plan_text(pairs)
        for name in stored.BUCKET_KEYS:
            spark.sql(f"DROP TABLE {prefix}_{name}")
        again = stored.open_bucketed(spark, SF, str(tmp_path / "t"), prefix, 4)
        plan = plan_text(REPORTS["ap_open_balance"](again))
        assert "Exchange" not in plan[plan.index("Join") :]
        assert _same(REPORTS["ap_open_balance"](again), QUERIES["ap_open_balance"](spark, SF))
    finally:
        for name in stored.BUCKET_KEYS:
            spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


MATCH_KEYS = ["ar_matching", "ar_paid_before_invoice", "ar_days_to_pay", "ar_avg_days_to_pay", "ar_timeliness", "ar_timeliness_summary"]


@needs_data
def test_reports_scan_the_stored_matches_once(spark, tmp_path):
    d = stored.stored_matches(Dataset(spark, SF), str(tmp_path))
    for key in MATCH_KEYS:
        plan = plan_text(REPORTS[key](d))
        assert plan.count("Scan parquet") == 1 and "Join" not in plan, key
        assert _same(REPORTS[key](d), QUERIES[key](spark, SF)), key
    for key in ("ar_timeliness_by_customer", "ar_slowest_paid"):
        assert "lineitem" not in plan_text(REPORTS[key](d))
        assert _same(REPORTS[key](d), QUERIES[key](spark, SF)), key
    assert _same(REPORTS["ar_unallocated_payments"](d), QUERIES["ar_unallocated_payments"](spark, SF))


@needs_data
def test_a_changed_input_is_seen(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    for name in ("orders", "lineitem", "customer", "nation"):
        shutil.copy(f"{SF}/{name}.parquet", root / f"{name}.parquet")
    d = Dataset(spark, str(root))
    first = stored.stored_matches(d, out)
    before = REPORTS["ar_matching"](first).count()
    assert stored.stored_matches(d, out)._matches == first._matches and len(os.listdir(out)) == 1
    written = os.stat(f"{first._matches}/_SUCCESS").st_mtime_ns
    stored.stored_matches(d, out)
    assert os.stat(f"{first._matches}/_SUCCESS").st_mtime_ns == written  # not built again
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_linenumber <= 2").coalesce(1).write.parquet(str(tmp_path / "less"))
    part = next(f for f in os.listdir(tmp_path / "less") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "less" / part, root / "lineitem.parquet")
    spark.catalog.clearCache()
    after = stored.stored_matches(Dataset(spark, str(root)), out)
    assert after._matches != first._matches and 0 < REPORTS["ar_matching"](after).count() < before
    os.remove(f"{after._matches}/_SUCCESS")  # as if the job had not ended
    assert REPORTS["ar_matching"](stored.stored_matches(Dataset(spark, str(root)), out)).count() < before


def test_a_batch_is_loaded_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = tables.rows_to_frame(spark, SEED_INVOICES, schemas.INVOICES)
    assert tables.append_batch(df, path, "2025-10") and not tables.append_batch(df, path, "2025-10")
    assert tables.append_batch(df.limit(3), path, "2025-11")
    got = tables.read_batches(spark, path)
    assert got.columns == df.columns and got.count() == len(SEED_INVOICES) + 3
    assert tables.read_batches(spark, path, schemas.INVOICES).exceptAll(got).count() == 0
    with pytest.raises(ValueError):
        tables.append_batch(df, path, "../x")


def test_a_load_that_fails_half_way_leaves_nothing_and_runs_again(spark, tmp_path):
    path = str(tmp_path / "t")
    ok = spark.range(0, 1000, 1, 4)
    tables.append_batch(ok.limit(10), path, "first")
    broken = ok.withColumn("id", F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        tables.append_batch(broken, path, "second")
    assert tables.read_batches(spark, path).count() == 10
    assert tables.append_batch(ok, path, "second") and not tables.append_batch(ok, path, "second")
    assert tables.read_batches(spark, path).count() == 1010


SEEDS = {
    "customers": (SEED_CUSTOMERS, schemas.CUSTOMERS), "invoices": (SEED_INVOICES, schemas.INVOICES), "payments": (SEED_PAYMENTS, schemas.PAYMENTS),
    "cash_applications": (SEED_CASH_APPLICATIONS, schemas.CASH_APPLICATIONS), "credit_notes": (SEED_CREDIT_NOTES, schemas.CREDIT_NOTES),
    "write_offs": (SEED_WRITE_OFFS, schemas.WRITE_OFFS),
}


@pytest.mark.parametrize("name", sorted(SEEDS))
def test_declared_tables_round_trip_from_text(spark, tmp_path, name):
    data, schema = SEEDS[name]
    text = spark.createDataFrame(data, schema).select(*[F.col(f).cast("string").alias(f) for f in schema.fieldNames()], F.lit("x").alias("more"))
    assert tables.load_rows(text, schema, str(tmp_path / "t"), str(tmp_path / "r"), "seed")
    assert not tables.load_rows(text, schema, str(tmp_path / "t"), str(tmp_path / "r"), "seed")
    got = tables.read_batches(spark, str(tmp_path / "t"))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in schema]
    assert sorted(rows(got)) == sorted(data)
    assert not os.path.exists(tmp_path / "r" / f"{tables.BATCH}=seed")


def test_rows_that_do_not_fit_are_set_aside_with_their_reasons(spark, tmp_path):
    good = ("1", "5", "2025-01-31", "12.50", "", None, None)
    bad = [("x", "5", "2025-01-31", "1", None, None, None), ("2", None, "2025-02-30", "1e40", "r", "m", "w"), (None, None, None, None, None, None, None)]
    came = spark.createDataFrame([good, *bad], ", ".join(f"{c} string" for c in schemas.PAYMENTS.fieldNames()))
    tables.load_rows(came, schemas.PAYMENTS, str(tmp_path / "t"), str(tmp_path / "r"), "b1")
    assert [r[0] for r in rows(tables.read_batches(spark, str(tmp_path / "t")))] == [1]
    found = {tuple(r["_reasons"]): r["_row"] for r in tables.read_batches(spark, str(tmp_path / "r")).collect()}
    assert set(found) == {
        ("payment_id: no bigint",),
        ("customer_id: null", "payment_date: no date", "amount: no decimal(18,2)"),
        ("payment_id: null", "customer_id: null", "payment_date: null", "amount: null"),
    }
    assert '"payment_date":"2025-02-30"' in found["customer_id: null", "payment_date: no date", "amount: no decimal(18,2)"]
    with pytest.raises(ValueError, match="missing columns: amount"):
        tables.conformed(came.drop("amount"), schemas.PAYMENTS)
