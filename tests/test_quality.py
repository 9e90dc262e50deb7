"""Key, null and reference checks."""

from __future__ import annotations

import random

from conftest import d, m, rows
from pyspark.sql.types import StructField, StructType

from paylens.operators import catalog, quality
from paylens.plans.explain import plan_text
from paylens.sources import schemas


def test_duplicate_keys_ignore_null_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1), (None, 1)], "a bigint, b bigint")
    assert rows(quality.duplicate_keys(df, ["a", "b"])) == [(1, 1, 2)]


def test_null_counts_one_row_per_column(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a bigint, b string")
    assert sorted(rows(quality.null_counts(df, ["a", "b"], table="t"))) == [("t", "a", 1), ("t", "b", 2)]


def test_orphans_skip_null_foreign_keys(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 12), (5, 12)], "id bigint, fk bigint")
    parent = spark.createDataFrame([(10,), (11,)], "pk bigint")
    assert sorted(rows(quality.orphans(child, parent, "fk", "pk"))) == [(4, 12), (5, 12)]


def test_constraint_violations_find_seeded_errors(spark, seed):
    bad_apps = seed["cash_applications"].unionByName(
        spark.createDataFrame([(3001, 9999, 1001, None, None, "x")], "application_id long, payment_id long, "
                              "invoice_id long, applied_amount decimal(18,2), applied_date date, applied_by string")
    )
    tables = dict(seed, cash_applications=bad_apps)
    got = {(r[0], r[1], r[2]): r[3] for r in quality.constraint_violations(tables).collect()}
    assert got[("cash_applications", "primary_key", "application_id")] == 1
    assert got[("cash_applications", "not_null", "applied_amount")] == 1
    assert got[("cash_applications", "foreign_key", "payment_id")] == 1
    assert got[("cash_applications", "foreign_key", "invoice_id")] == 0


def test_declared_checks_take_one_scan_a_table_and_one_shuffle(spark, seed, tmp_path):
    for name, df in seed.items():
        df.write.parquet(str(tmp_path / name))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in seed}
    plan = plan_text(quality.constraint_violations(tables))
    assert plan.count("Scan parquet") == 6 and plan.count("Exchange hashpartitioning(owner") == 2 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # key values, then one row for each table and column


def test_declared_checks_equal_the_single_checks(spark):
    rnd = random.Random(12)

    def some(k):
        return None if rnd.random() < 0.1 else rnd.randrange(k)

    day, money = d("2025-01-01"), m("1.00")
    data = {
        "customers": [(some(30), "n", "s", "c", day) for _ in range(25)],
        "invoices": [(some(60), some(40), day, day if some(3) else None, money, "OPEN", "x", None) for _ in range(60)],
        "payments": [(some(60), some(40), day, money, None, None, None) for _ in range(50)],
        "cash_applications": [(some(200), some(70), 7 if rnd.random() < 0.4 else some(70), money, day, None) for _ in range(150)],
        "credit_notes": [(some(50), some(90), day, None, None, None) for _ in range(40)],
        "write_offs": [],
    }
    shapes = {"customers": schemas.CUSTOMERS, "invoices": schemas.INVOICES, "payments": schemas.PAYMENTS,
              "cash_applications": schemas.CASH_APPLICATIONS, "credit_notes": schemas.CREDIT_NOTES, "write_offs": schemas.WRITE_OFFS}
    loose = {t: StructType([StructField(f.name, f.dataType) for f in shape]) for t, shape in shapes.items()}
    tables = {t: spark.createDataFrame(data[t], loose[t]) for t in shapes}
    got = {tuple(r)[:3]: r["violations"] for r in quality.constraint_violations(tables).collect()}
    want = {}
    for t, (pk, required, fks) in schemas.KEYS.items():
        want[t, "primary_key", ",".join(pk)] = quality.duplicate_keys(tables[t], pk).count()
        want |= {(t, "not_null", r["column_name"]): r["null_count"] for r in quality.null_counts(tables[t], required, table=t).collect()}
        want |= {(t, "foreign_key", fk): quality.orphans(tables[t], tables[parent], fk, key).count() for fk, parent, key in fks}
    assert got == want and sum(v > 0 for k, v in got.items() if k[1] == "foreign_key") >= 4


def test_text_and_compound_keys_are_compared_as_text(spark, monkeypatch):
    keys = {"a": (["x", "y"], ["x"], []), "b": (["z"], ["z"], [("r", "c", "k")]), "c": (["k"], ["k"], [])}
    monkeypatch.setattr(quality, "KEYS", keys)
    tables = {
        "a": spark.createDataFrame([(1, "p"), (1, "p"), (1, "q"), (None, "p"), (None, "p")], "x bigint, y string"),
        "b": spark.createDataFrame([("u", "5"), ("u", "6"), (None, None)], "z string, r string"),
        "c": spark.createDataFrame([(5,)], "k int"),
    }
    got = {tuple(r)[:3]: r["violations"] for r in quality.constraint_violations(tables).collect()}
    assert got == {("a", "primary_key", "x,y"): 1, ("a", "not_null", "x"): 2, ("b", "primary_key", "z"): 1, ("b", "not_null", "z"): 1,
                   ("b", "foreign_key", "r"): 1, ("c", "primary_key", "k"): 0, ("c", "not_null", "k"): 0}


def test_describe_lists_sql_types(spark):
    df = spark.createDataFrame([], schemas.RISK_PAYMENTS)
    got = rows(catalog.describe(df), "cid", "name", "type")
    assert got[:4] == [(0, "transaction_id", "BIGINT"), (1, "user_id", "BIGINT"),
                       (2, "transaction_time", "TIMESTAMP"), (3, "amount", "DECIMAL(18,2)")]
    assert len(got) == 10


def test_describe_counts_rows_and_flags_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a bigint, b string")
    assert rows(catalog.describe(df)) == [(0, "a", "BIGINT", 1, 2), (1, "b", "VARCHAR", 0, 2)]
