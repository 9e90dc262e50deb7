"""Activity in the last N hours before each user's own latest transaction.

"Last 24 h" is anchored on the user's latest transaction time, not on "now",
and gives one row per user. Hours are whole-second differences / 3600.

Counts come from a rollup: one row per (user, hour) with the number of rows and the
latest time, counted in the scan tasks before it moves. A user's rollup is one row with
the hours in a list (bounded by the hours that the log spans, not by its rows); it gives
the latest time, the second at which the window starts, and the sum of all full hours.
Only the hour in which the window starts is read finer, by seconds. Of the rows, those
of such hours are picked before they move: users fall into ``SLOTS`` slots by a hash, a
table of that many rows holds for each slot the range of its users' boundary hours, and
it is broadcast whatever the number of users. With more users than slots the ranges are
wider and some more rows move; the join with the user's own hour decides.

Distinct-only variants first reduce the rows to one per (user, value) with
that value's latest time: a value occurs in the window exactly when its
latest occurrence does, and the user's latest time is the max over values. No
``max() OVER (PARTITION BY user)`` window puts a hot user's history into one task.
Null users form their own group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.exprs import hours_between
from paylens.operators.activity import PURCHASE


HOUR = 3600
SLOTS = 65_536


def _slot(user: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(user), F.lit(SLOTS))


def _windows(tx: DataFrame, hours: float, counted: F.Column, user: str, ts: str) -> DataFrame:
    """Per user (_u): the window's first second (_from), its hour (_edge) and the count of
    the hours after it (_full); _from is null for users with undated rows only."""
    hour = F.floor(F.unix_timestamp(ts) / HOUR)
    rollup = tx.groupBy(F.col(user).alias("_u"), hour.alias("_hour")).agg(counted.alias("_n"), F.max(F.unix_timestamp(ts)).alias("_last"))
    per_user = rollup.groupBy("_u").agg(F.max("_last").alias("_last"), F.collect_list(F.struct("_hour", "_n")).alias("_hours"))
    start = per_user.withColumn("_from", F.ceil(F.col("_last") - F.lit(float(hours)) * HOUR).cast("bigint"))
    edged = start.withColumn("_edge", F.floor(F.col("_from") / HOUR))
    full = F.aggregate(
        F.filter("_hours", lambda h: h["_hour"] > F.col("_edge")), F.lit(0).cast("bigint"), lambda total, h: total + h["_n"]
    )
    return edged.select("_u", "_from", "_edge", full.alias("_full"))


def _near_the_edge(rows: DataFrame, windows: DataFrame, user: str, ts: str) -> DataFrame:
    """(r_u, _hour, _second) of the rows in a boundary hour of their user's slot: SLOTS
    rows are broadcast, at most."""
    slots = windows.groupBy(_slot(F.col("_u")).alias("_slot")).agg(F.min("_edge").alias("_low"), F.max("_edge").alias("_high"))
    second = F.unix_timestamp(ts)
    rows = rows.select(F.col(user).alias("r_u"), second.alias("_second"), F.floor(second / HOUR).alias("_hour"), _slot(F.col(user)).alias("r_slot"))
    inside = (F.col("r_slot") == F.col("_slot")) & F.col("_hour").between(F.col("_low"), F.col("_high"))
    return rows.join(F.broadcast(slots), inside).select("r_u", "_hour", "_second")


def _windowed_counts(tx: DataFrame, hours: float, when: F.Column | None, user: str, ts: str) -> DataFrame:
    """(_u, _count): the rows (matching ``when``) in each user's window; every user."""
    counted = F.count(F.lit(1)) if when is None else F.count_if(when)
    windows = _windows(tx, hours, counted, user, ts)
    near = _near_the_edge(tx if when is None else tx.where(when), windows, user, ts)
    seconds = near.groupBy("r_u", "_hour", "_second").agg(F.count(F.lit(1)).alias("_k"))
    inside = F.col("_u").eqNullSafe(F.col("r_u")) & (F.col("_edge") == F.col("_hour")) & (F.col("_second") >= F.col("_from"))
    edge = F.coalesce(F.sum("_k"), F.lit(0))
    return windows.join(seconds, inside, "left").groupBy("_u").agg((F.max("_full") + edge).alias("_count"))


def with_hours_from_last(df: DataFrame, *, user: str = "user_id", ts: str = "transaction_time") -> DataFrame:
    """Adds ``hours_from_last``: hours from each row to its user's latest time."""
    last = df.groupBy(F.col(user).alias("_u")).agg(F.max(ts).alias("_last"))
    joined = df.join(last, df[user].eqNullSafe(last["_u"]))
    return joined.withColumn("hours_from_last", hours_between("_last", ts)).drop("_u", "_last")


def recent_activity(
    tx: DataFrame,
    hours: float = 24,
    min_cards: int = 3,
    *,
    user: str = "user_id",
    ts: str = "transaction_time",
    card: str = "card_id",
    type_col: str = "tx_type",
    ordered: bool = True,
) -> DataFrame:
    """Distinct cards and purchases in the last ``hours``; users with >= ``min_cards`` cards.

    Cards come from the latest time per (user, card), purchases from the purchase
    rows alone; both are joined to the users' latest times.
    """
    last = tx.groupBy(F.col(user).alias("_u")).agg(F.max(ts).alias("_last"))
    latest = tx.groupBy(F.col(user).alias("c_u"), card).agg(F.max(ts).alias("_t"))
    cards = (
        latest.join(last, F.col("c_u").eqNullSafe(F.col("_u")))
        .where(hours_between("_last", "_t") <= hours)
        .groupBy("c_u")
        .agg(F.count(card).alias("cards_last_24h"))
        .where(F.col("cards_last_24h") >= min_cards)
    )
    bought = recent_count(tx, hours, when=F.col(type_col) == PURCHASE, min_count=1, name="_n", user=user, ts=ts, ordered=False)
    bought = bought.select(F.col(user).alias("p_u"), "_n")
    out = cards.join(bought, F.col("c_u").eqNullSafe(F.col("p_u")), "left").select(
        F.col("c_u").alias(user), "cards_last_24h", F.coalesce("_n", F.lit(0)).cast("bigint").alias("purchases_last_24h")
    )
    return out.orderBy(F.col("cards_last_24h").desc(), F.col("purchases_last_24h").desc(), F.col(user).asc()) if ordered else out


def recent_distinct(
    tx: DataFrame,
    column: str,
    hours: float = 24,
    min_count: int = 2,
    *,
    name: str | None = None,
    user: str = "user_id",
    ts: str = "transaction_time",
    ordered: bool = True,
) -> DataFrame:
    """Users with >= ``min_count`` distinct non-null ``column`` values in the last ``hours``."""
    name = name or f"{column}_count"
    latest_per_value = tx.groupBy(user, column).agg(F.max(ts).alias(ts))
    scored = with_hours_from_last(latest_per_value, user=user, ts=ts)
    out = (
        scored.filter(F.col("hours_from_last") <= hours)
        .groupBy(user)
        .agg(F.count(column).alias(name))
        .filter(F.col(name) >= min_count)
    )
    return out.orderBy(F.col(name).desc(), F.col(user).asc()) if ordered else out


def recent_count(
    tx: DataFrame,
    hours: float = 24,
    *,
    when: F.Column | None = None,
    min_count: int | None = None,
    name: str = "tx_24h",
    user: str = "user_id",
    ts: str = "transaction_time",
    ordered: bool = True,
) -> DataFrame:
    """Per user: rows (matching ``when``) in the last ``hours``.

    Without ``min_count`` every user is listed (0 when only undated rows), as
    in the velocity report; with it, users below the threshold drop out.
    """
    found = _windowed_counts(tx, hours, when, user, ts)
    out = found.select(F.col("_u").alias(user), F.coalesce("_count", F.lit(0)).cast("bigint").alias(name))
    if min_count is not None:
        out = out.filter(F.col(name) >= min_count)
    return out.orderBy(F.col(name).desc(), F.col(user).asc()) if ordered else out
