"""Trailing windows and consecutive gaps against a brute-force self join."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F

from paylens.operators import trailing

SCHEMA = "user_id bigint, transaction_time timestamp_ntz, country string"


def _brute_count(df, seconds):
    a, b = df.alias("a"), df.alias("b")
    cond = (F.col("a.user_id") == F.col("b.user_id")) & F.col("b.transaction_time").between(
        F.col("a.transaction_time") - F.expr(f"INTERVAL {seconds} SECONDS"), F.col("a.transaction_time")
    )
    return {
        (r[0], r[1]): r[2]
        for r in a.join(b, cond).groupBy("a.user_id", "a.transaction_time").agg(F.count(F.lit(1))).collect()
    }


def _brute_distinct(df, seconds, col="country"):
    a, b = df.alias("a"), df.alias("b")
    cond = (F.col("a.user_id") == F.col("b.user_id")) & F.col("b.transaction_time").between(
        F.col("a.transaction_time") - F.expr(f"INTERVAL {seconds} SECONDS"), F.col("a.transaction_time")
    )
    out = a.join(b, cond).groupBy("a.user_id", "a.transaction_time").agg(F.countDistinct(f"b.{col}"))
    return {(r[0], r[1]): r[2] for r in out.collect()}


def _random_rows(seed, n=600, users=6, span_hours=60):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for _ in range(n):
        # one hot user with about half the rows
        u = 1 if rnd.random() < 0.5 else rnd.randint(2, users)
        if rnd.random() < 0.03:
            u = None
        secs = rnd.randint(0, span_hours * 3600)
        t = base + dt.timedelta(seconds=secs, microseconds=rnd.choice([0, 0, 1, 500000, 999999]))
        if rnd.random() < 0.02:
            t = None
        c = rnd.choice(["MT", "IT", "DE", None])
        out.append((u, t, c))
        if rnd.random() < 0.1 and t is not None:  # exact duplicates and same-instant rows
            out.append((u, t, rnd.choice(["MT", "FR"])))
    # rows exactly one window apart and at bucket edges
    edge = dt.datetime(2024, 1, 2)  # a multiple of one hour and of 24 hours
    out += [(7, edge - dt.timedelta(hours=1), "A"), (7, edge, "B"), (7, edge, "B"),
            (7, edge + dt.timedelta(hours=1), "C"), (7, edge - dt.timedelta(microseconds=1), "D"),
            (7, edge + dt.timedelta(hours=1, microseconds=1), "A")]
    return out


# (window, strategy, rows a user may have in one group): uncut time lines and
# ones cut into few or many groups must give the same answer
CASES = [
    ("1 hour", "window", None),
    ("24 hours", "window", None),
    ("1 hour", "bucketed", 1_000_000),
    ("24 hours", "bucketed", 1_000_000),
    ("1 hour", "bucketed", 20),
    ("24 hours", "bucketed", 20),
    ("24 hours", "bucketed", 150),
]


def _opts(strategy, bucket_rows):
    return {"strategy": strategy} | ({} if bucket_rows is None else {"bucket_rows": bucket_rows})


@pytest.mark.parametrize("window,strategy,bucket_rows", CASES)
def test_trailing_count_matches_self_join(spark, window, strategy, bucket_rows):
    df = spark.createDataFrame(_random_rows(11), SCHEMA)
    secs = trailing.window_seconds(window)
    want = {k: v for k, v in _brute_count(df, secs).items() if v >= 2}
    got = trailing.trailing_count(df, window, 2, name="n", **_opts(strategy, bucket_rows))
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want


@pytest.mark.parametrize("window,strategy,bucket_rows", CASES)
def test_trailing_distinct_matches_self_join(spark, window, strategy, bucket_rows):
    df = spark.createDataFrame(_random_rows(23), SCHEMA)
    secs = trailing.window_seconds(window)
    want = {k: v for k, v in _brute_distinct(df, secs).items() if v >= 1}
    got = trailing.trailing_distinct(df, "country", window, 1, name="n", **_opts(strategy, bucket_rows))
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want


def test_same_instant_rows_multiply(spark):
    t = ts("2024-01-01 10:00:00")
    df = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (1, ts("2024-01-01 09:30:00"), "y")], SCHEMA)
    got = rows(trailing.trailing_count(df, "1 hour", 1, name="n"), "user_id", "transaction_time", "n")
    # two rows at 10:00, three rows in their window: 2 * 3
    assert sorted(got) == [(1, ts("2024-01-01 09:30:00"), 1), (1, t, 6)]


def test_only_null_values_count_zero(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01 10:00:00"), None)], SCHEMA)
    assert rows(trailing.trailing_distinct(df, "country", "1 hour", 0, name="n"), "n") == [(0,)]


def test_top_n_ties_broken_by_user_then_time(spark):
    t = ts("2024-01-01 10:00:00")
    df = spark.createDataFrame([(u, t, c) for u in (3, 1, 2) for c in ("a", "b")], SCHEMA)
    got = rows(trailing.trailing_distinct(df, "country", "24 hours", 2, name="n", n=2), "user_id")
    assert got == [(1,), (2,)]


def _brute_gaps(df, max_hours):
    df.createOrReplaceTempView("cb_fixture")
    out = df.sparkSession.sql(
        f"""
        SELECT user_id, prev_cb_time, transaction_time,
               (unix_timestamp(transaction_time) - unix_timestamp(prev_cb_time)) / 3600D AS hours_diff
        FROM (SELECT user_id, transaction_time,
                     lag(transaction_time) OVER (PARTITION BY user_id ORDER BY transaction_time) AS prev_cb_time
              FROM cb_fixture)
        WHERE prev_cb_time IS NOT NULL
          AND (unix_timestamp(transaction_time) - unix_timestamp(prev_cb_time)) / 3600D <= {max_hours}
        """
    )
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("max_hours,bucket_rows", [(1, 1_000_000), (48, 1_000_000), (48, 10), (1, 30)])
def test_consecutive_gap_matches_plain_lag(spark, max_hours, bucket_rows):
    data = [(u, t, c) for u, t, c in _random_rows(5, n=300, span_hours=400) if t is not None]
    data += [(None, ts("2024-01-05 10:00:00"), "x"), (None, ts("2024-01-05 10:10:00"), "x")]
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted(rows(trailing.consecutive_gap(df, max_hours, bucket_rows=bucket_rows)), key=repr)
    assert got == _brute_gaps(df, max_hours)
    assert any(r[0] is None for r in got)  # null users form their own sequence


def test_gap_boundary_uses_whole_seconds(spark):
    df = spark.createDataFrame(
        [(1, ts("2024-01-01 00:00:00.900"), "x"), (1, ts("2024-01-03 00:00:00.100"), "x")], SCHEMA
    )
    # 47 h 59 m 59.2 s apart, but 48 h in whole seconds: kept, hours_diff = 48.0
    assert rows(trailing.consecutive_gap(df, 48), "hours_diff") == [(48.0,)]


# ---- property-based: random data, window and bucket widths ----------------------
from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_row = st.tuples(
    st.sampled_from([1, 2, 3, None]),
    st.integers(0, 6 * 3600),
    st.sampled_from([0, 1, 999_999]),
    st.sampled_from(["a", "b", "c", None]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(_row, min_size=1, max_size=40),
    window=st.sampled_from(["10 minutes", "1 hour"]),
    rows_a_group=st.sampled_from([1_000_000, 3]),
)
def test_random_inputs_match_self_join(spark, data, window, rows_a_group):
    base = dt.datetime(2024, 3, 10)
    df = spark.createDataFrame(
        [(u, base + dt.timedelta(seconds=s, microseconds=us), v) for u, s, us, v in data], SCHEMA
    )
    secs = trailing.window_seconds(window)
    cut = {"bucket_rows": rows_a_group, "ordered": False}
    got = trailing.trailing_count(df, window, 1, name="n", **cut)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == _brute_count(df, secs)
    got = trailing.trailing_distinct(df, "country", window, 0, name="n", **cut)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == _brute_distinct(df, secs)
    max_hours = secs / 3600
    gaps = sorted(rows(trailing.consecutive_gap(df, max_hours, **cut)), key=repr)
    assert gaps == _brute_gaps(df, max_hours)


def _group_sizes(spark, data, bucket_rows):
    instants = spark.createDataFrame(data, "_u bigint, _t timestamp_ntz")
    found = trailing._grouped(instants, ["_u"], bucket_rows).groupBy("_u", "_b").agg(F.count("*").alias("n"), F.min("_t").alias("a"), F.max("_t").alias("z")).collect()
    out = {}
    for r in sorted(found, key=lambda r: r["_b"]):
        out.setdefault(r["_u"], []).append(r)
    for groups in out.values():  # groups follow each other in time
        assert all(a["z"] < b["a"] for a, b in zip(groups, groups[1:]))
    return {u: [r["n"] for r in groups] for u, groups in out.items()}


def test_groups_follow_the_rows_of_a_user(spark):
    base = dt.datetime(1968, 1, 1)
    burst = [(1, base + dt.timedelta(microseconds=100 * i)) for i in range(100_000)]  # 100,000 instants in 10 seconds
    burst += [(None, t) for _, t in burst[:20_000]] + [(2, base + dt.timedelta(hours=i)) for i in range(500)]
    sizes = _group_sizes(spark, burst, 1000)
    assert sum(sizes[1]) == 100_000 and max(sizes[1]) <= 1500 and len(sizes[1]) >= 67
    assert max(sizes[None]) <= 1500 and sizes[2] == [500]


def test_ten_thousand_groups_of_one_user(spark):
    base = dt.datetime(2024, 1, 1)
    dense = [(1, base + dt.timedelta(microseconds=i)) for i in range(100_000)] + [(1, base + dt.timedelta(days=i % 9000, microseconds=i)) for i in range(100_000)]
    sizes = _group_sizes(spark, sorted(set(dense)), 20)
    assert len(sizes[1]) >= 9_000 and max(sizes[1]) <= 30


def test_two_events_per_occurrence_however_fine_the_groups(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(1, base + dt.timedelta(milliseconds=7 * i), str(i % 50)) for i in range(2000)]
    occurrences = spark.createDataFrame(data, "_u bigint, _t timestamp_ntz, _v string")
    for bucket_rows in (10, 100, 10**6):
        leaving = trailing._hot_leaving(occurrences, 60, bucket_rows)
        assert leaving.count() == len(data)
        assert trailing._events(leaving, "CAST(1 AS BIGINT)", "CAST(1 AS BIGINT)").count() <= 2 * len(data)


def test_equal_rows_of_a_hot_user_move_as_counts(spark):
    """Many rows at one instant: chunks with a number, each pair is still a row."""
    t = ts("2024-01-01 10:00:00")
    df = spark.createDataFrame([(1, t, "x")] * 5000 + [(1, t + dt.timedelta(hours=1), "x")] * 3, SCHEMA)
    got = rows(trailing.consecutive_gap(df, 48, bucket_rows=100), "prev_cb_time", "transaction_time")
    assert len(got) == 5002 and got.count((t, t)) == 4999 and got.count((t, t + dt.timedelta(hours=1))) == 1
    counted = rows(trailing.trailing_count(df, "1 hour", 1, name="n", bucket_rows=100), "n")
    assert sorted(counted) == [(3 * 5003,), (5000 * 5000,)]


def _final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("Final Plan") : text.index("Initial Plan")]


@pytest.mark.parametrize("build", [
    lambda df, b: trailing.trailing_count(df, "1 hour", 1, name="n", bucket_rows=b),
    lambda df, b: trailing.trailing_distinct(df, "country", "1 hour", 1, bucket_rows=b),
    lambda df, b: trailing.consecutive_gap(df, 48, bucket_rows=b),
])
def test_without_hot_users_there_is_one_exchange_of_rows_and_no_join(spark, tmp_path, monkeypatch, build):
    spark.createDataFrame(_random_rows(3), SCHEMA).write.parquet(str(tmp_path / "tx"))
    df = spark.read.parquet(str(tmp_path / "tx"))
    joins = ("SortMergeJoin", "HashJoin")
    small = build(df, 10**6)  # less than one task's input: no second branch is planned
    assert not any(j in small._jdf.queryExecution().executedPlan().toString() for j in joins)
    monkeypatch.setattr(trailing, "BYTES_A_ROW", 0)  # as for a large input: it is dropped at run time
    assert small.exceptAll(build(df, 10**6)).count() == 0
    plan = _final_plan(build(df, 10**6))
    assert not any(j in plan for j in joins) and plan.count("Exchange hashpartitioning(_u") == 1
    assert any(j in _final_plan(build(df, 50)) for j in joins)


def test_building_a_plan_runs_no_job(spark):
    df = spark.createDataFrame(_random_rows(3), SCHEMA)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("trailing-build", "")
    trailing.trailing_count(df, "1 hour", 2, name="n")
    trailing.trailing_distinct(df, "country", "1 hour", 1)
    trailing.consecutive_gap(df, 48)
    assert len(tracker.getJobIdsForGroup("trailing-build")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_small_purchases_amount_bounds(spark):
    from decimal import Decimal

    df = spark.createDataFrame(
        [(1, "purchase", Decimal(a)) for a in ("0.00", "0.01", "10.00", "10.01")] + [(1, "chargeback", Decimal("5.00"))],
        "user_id bigint, tx_type string, amount decimal(18,2)",
    )
    got = sorted(r[0] for r in trailing.small_purchases(df).select("amount").collect())
    assert got == [Decimal("0.01"), Decimal("10.00")]  # 0 < amount <= 10, purchases only
