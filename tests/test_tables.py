"""Tables written, appended to, rewritten and stored."""

from __future__ import annotations

import os

import pytest
from conftest import SEED_INVOICES, TESTDATA

from paylens.operators import ledger, matching, trailing
from paylens.sources import schemas
from paylens.sources.adapters import Dataset
from paylens.sources.tables import append_table, create_table, read_table, refresh_table, rows_to_frame, table_path, write_table

SF = f"{TESTDATA}/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_a_rewritten_table_shows_its_new_columns(spark, tmp_path):
    root = str(tmp_path)
    write_table(spark.createDataFrame([(1,)], "a bigint"), table_path(root, "t"))
    assert read_table(spark, root, "t").columns == ["a"]
    write_table(spark.createDataFrame([(1, "x")], "a bigint, b string"), table_path(root, "t"))
    again = read_table(spark, root, "t")
    assert again.columns == ["a", "b"] and again.collect() == [(1, "x")]


def test_create_table_with_fixed_schema_then_append(spark, tmp_path):
    name, folder = f"invoices_{os.getpid()}", f"{tmp_path}/invoices"
    table = create_table(spark, name, folder, schemas.INVOICES)
    assert [f.name for f in table.schema.fields] == [f.name for f in schemas.INVOICES.fields]
    assert table.count() == 0
    for _ in range(2):
        append_table(rows_to_frame(spark, SEED_INVOICES, schemas.INVOICES), folder)
    refresh_table(spark, name)
    assert spark.table(name).count() == spark.read.parquet(folder).count() == 2 * len(SEED_INVOICES)
    spark.sql(f"DROP TABLE {name}")


@needs_data
def test_stored_tables_give_the_same_results(spark, tmp_path):
    raw = Dataset(spark, SF)
    stored = raw.materialize(str(tmp_path))
    assert "get_json_object" not in stored.transactions()._jdf.queryExecution().executedPlan().toString()
    for build in (
        lambda d: trailing.trailing_distinct(d.transactions(), "country", "24 hours", 2, name="n", ordered=False),
        lambda d: ledger.aging(d.vendors(), d.bills(), d.payment_applications(), "1998-06-30", ordered=False),
        lambda d: matching.slowest_paid(d.invoices(), d.cash_applications(), d.payments(), d.customer_names()),
    ):
        a, b = build(raw), build(stored)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert all(str(tmp_path) in f for f in stored.customer_names().inputFiles())


@needs_data
def test_tables_that_were_not_stored_are_adapted(spark, tmp_path):
    stored = Dataset(spark, SF).materialize(str(tmp_path), ("bills",))
    assert stored.vendors().count() == Dataset(spark, SF).vendors().count()
    assert stored.bills().count() == Dataset(spark, SF).bills().count()


@needs_data
def test_receivables_tables_have_their_declared_columns(spark):
    d = Dataset(spark, SF)
    declared = {
        "customers": schemas.CUSTOMERS, "invoices": schemas.INVOICES, "payments": schemas.PAYMENTS,
        "cash_applications": schemas.CASH_APPLICATIONS, "credit_notes": schemas.CREDIT_NOTES, "write_offs": schemas.WRITE_OFFS,
    }
    for name, schema in declared.items():
        got = getattr(d, name)().schema
        assert [(f.name, f.dataType) for f in got] == [(f.name, f.dataType) for f in schema], name
    assert set(schemas.RISK_PAYMENTS.fieldNames()) <= set(d.transactions().columns)
