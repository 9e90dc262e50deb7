"""Anchored recency (relative to each user's latest transaction) and concentration."""

from __future__ import annotations

import random

import pytest
from conftest import m, rows, ts
from pyspark.sql import functions as F

from paylens.operators import concentration, recency
from paylens.sources import schemas

LAST = "2024-01-02 10:00:00.100"


def _tx(spark, spec):
    """spec: (user, time text, card/device/country, tx_type, status)."""
    out = [(i, u, ts(t) if t else None, m("1.00"), "m1", v, None, v, "card", s) for i, (u, t, v, _, s) in enumerate(spec)]
    df = spark.createDataFrame(out, schemas.RISK_PAYMENTS)
    types = {i: k for i, (_, _, _, k, _) in enumerate(spec)}
    tx_type = F.element_at(F.create_map(*[x for i, k in types.items() for x in (F.lit(i), F.lit(k))]), F.col("transaction_id"))
    return df.withColumn("tx_type", tx_type).withColumn("card_id", F.col("device_id"))


def test_window_bound_uses_whole_seconds(spark):
    tx = _tx(
        spark,
        [
            (1, LAST, "a", "purchase", "approved"),
            (1, "2024-01-01 10:00:00.900", "b", "purchase", "approved"),  # 86400 s in whole seconds: in
            (1, "2024-01-01 09:59:59.900", "c", "purchase", "approved"),  # 86401 s: out
            (1, "2024-01-01 12:00:00", "d", "chargeback", "declined"),
        ],
    )
    assert rows(recency.recent_activity(tx, 24, 3)) == [(1, 3, 2)]
    assert rows(recency.recent_distinct(tx, "device_id", 24, 1, name="n")) == [(1, 3)]
    assert rows(recency.recent_count(tx, 24, name="n")) == [(1, 3)]
    declined = F.col("status") == "declined"
    assert rows(recency.recent_count(tx, 24, when=declined, min_count=1, name="n")) == [(1, 1)]


def test_velocity_lists_every_user_including_null_and_undated(spark):
    tx = _tx(
        spark,
        [
            (None, LAST, "a", "purchase", "approved"),
            (None, "2024-01-02 09:00:00", "a", "purchase", "approved"),
            (2, None, "a", "purchase", "approved"),
            (3, LAST, "a", "purchase", "approved"),
        ],
    )
    got = sorted(rows(recency.recent_count(tx, 24, name="tx_24h")), key=repr)
    assert got == [(2, 0), (3, 1), (None, 2)]


def _random_log(spark, n=3000, users=40, days=5):
    rnd = random.Random(17)
    spec = []
    for _ in range(n):
        u = rnd.choice([1, 1, *range(2, users), None])
        t = None if rnd.random() < 0.02 else f"2024-01-{rnd.randint(1, days):02d} {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:{rnd.randint(0, 59):02d}.{rnd.choice(['0', '5'])}"
        spec.append((u, t, rnd.choice("abcd"), "purchase", rnd.choice(["approved", "declined"])))
    spec.append((9999, None, "a", "purchase", "approved"))
    return _tx(spark, spec)


@pytest.mark.parametrize("hours", [24, 1, 0.5, 49])
@pytest.mark.parametrize("declined_only", [False, True])
def test_rollup_counts_equal_the_window_form(spark, hours, declined_only):
    tx = _random_log(spark)
    tx.createOrReplaceTempView("recency_log")
    hit = "status = 'declined'" if declined_only else "true"
    want = spark.sql(
        f"""
        SELECT user_id, count_if({hit} AND s - unix_timestamp(transaction_time) <= {hours} * 3600) AS n FROM (
          SELECT *, unix_timestamp(max(transaction_time) OVER (PARTITION BY user_id)) AS s FROM recency_log
        ) GROUP BY user_id"""
    )
    when = F.col("status") == "declined" if declined_only else None
    got = recency.recent_count(tx, hours, when=when, name="n")
    assert sorted(rows(got), key=repr) == sorted(rows(want), key=repr)
    least = recency.recent_count(tx, hours, when=when, min_count=3, name="n")
    assert sorted(rows(least), key=repr) == sorted((r for r in rows(want) if r[1] >= 3), key=repr)


def test_only_rows_of_the_boundary_hour_move_by_second(spark, monkeypatch):
    tx = _random_log(spark)
    windows = recency._windows(tx, 24, F.count(F.lit(1)), "user_id", "transaction_time")
    edges = {r["_u"]: r["_edge"] for r in windows.collect()}
    near = recency._near_the_edge(tx, windows, "user_id", "transaction_time").collect()
    assert 0 < len(near) < 0.1 * tx.count()
    assert all(r["_hour"] == edges[r["r_u"]] for r in near)
    monkeypatch.setattr(recency, "SLOTS", 3)  # users share slots: more rows move, the counts stay
    assert recency._near_the_edge(tx, windows, "user_id", "transaction_time").count() > len(near)
    few = sorted(rows(recency.recent_count(tx, 24, name="n")), key=repr)
    monkeypatch.undo()
    assert few == sorted(rows(recency.recent_count(tx, 24, name="n")), key=repr)


def test_recent_distinct_equals_window_form(spark):
    rnd = random.Random(3)
    spec = []
    for _ in range(400):
        u = rnd.choice([1, 1, 1, 2, 3, None])
        t = f"2024-01-0{rnd.randint(1, 4)} {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:0{rnd.randint(0, 9)}"
        spec.append((u, t, rnd.choice(["a", "b", "c", "d", None]), "purchase", "approved"))
    tx = _tx(spark, spec)
    tx.createOrReplaceTempView("recency_fixture")
    want = spark.sql(
        """
        SELECT user_id, COUNT(DISTINCT device_id) AS n FROM (
          SELECT user_id, device_id,
                 (unix_timestamp(max(transaction_time) OVER (PARTITION BY user_id))
                  - unix_timestamp(transaction_time)) / 3600D AS h
          FROM recency_fixture)
        WHERE h <= 24 GROUP BY user_id HAVING COUNT(DISTINCT device_id) >= 2
        """
    )
    got = recency.recent_distinct(tx, "device_id", 24, 2, name="n")
    assert sorted(rows(got), key=repr) == sorted(rows(want), key=repr)


def test_concentration_share_is_strict_and_null_merchant_is_a_group(spark):
    def pay(user, merchants):
        return [(i, user, ts(LAST), m("1.00"), mm, "MT", None, "d", "card", "approved") for i, mm in enumerate(merchants)]

    data = (
        pay(1, ["a"] * 6 + ["b"] * 4)  # exactly 0.60: out
        + pay(2, ["a"] * 7 + ["b"] * 3)  # 0.70: in
        + pay(3, [None] * 7 + ["b"] * 3)  # the null merchant group holds 0.70: in
        + pay(4, ["a"] * 9)  # 9 transactions only: out
    )
    tx = spark.createDataFrame(data, schemas.RISK_PAYMENTS)
    got = sorted(rows(concentration.concentration(tx)))
    assert got == [(2, 10, 0.7), (3, 10, 0.7)]
