"""Trailing-window counts per transaction, and gaps between consecutive events.

The source analyses write these as self joins on user with a time range, grouped
by (user, t1). A self join costs the square of the rows per user. Here they are sorts
and running sums.

* ``trailing_count``: with k rows at one instant and n rows in its window, the self
  join gives k * n.
* ``trailing_distinct``: distinct non-null values in the window, per (user, t1).

A window count is a sweep: +1 where something enters the window, -1 just after it
leaves, and a running sum in time order. An instant enters at its time and leaves
after the window's length; an occurrence of a value leaves earlier if the value
occurs again before.

Two branches, by the user's number of rows:

* Users of at most ``bucket_rows`` rows: their narrow rows move once, to the user's
  partition; counting instants, finding a value's next time and the sweep all happen
  there.
* Users of more rows: rows are counted per (user, instant) in the scan tasks, then each
  user's time line is cut into groups. A cell is so short a time that it holds at most
  half a group of distinct microseconds; cells are counted, summed up in two levels
  (blocks of cells, cells in a block), and a row's group is the number of rows before
  its cell divided by ``bucket_rows``. So a user has as many groups as rows need, of at
  most 1.5 times ``bucket_rows`` rows, be they years or microseconds apart. A group's
  start is the sum over earlier groups, from one total for each group.

Which users have many rows is a count per user in the same plan (a partial count in the
scan tasks), broadcast: at most ``HOT_USERS`` ids, those with the most rows. Where no
user has so many rows, adaptive execution drops the join and the second branch; more
than ``HOT_USERS`` such users leave the smaller ones in the first branch, with groups of
at most all rows / ``HOT_USERS``. No job runs while the plan is built; files of less than
``BYTES_A_ROW`` * ``bucket_rows`` bytes in all, one task's input, have the first branch
alone.

``strategy="window"`` is the direct form, one RANGE frame per user: for small data
and as a cross-check.

Rows with a null user or a null time never match in the self join and are dropped
from the windows. Bounds are exact at microsecond resolution and inclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
BUCKET_ROWS = 1_000_000
HOT_USERS = 100_000
CELLS_PER_BLOCK = 4096
ROWS_PER_CHUNK = 65_536
BYTES_A_ROW = 128


def window_seconds(window: str | int) -> int:
    """``"1 hour"`` / ``"24 hours"`` / ``"30 minutes"`` / seconds -> whole seconds."""
    if isinstance(window, int):
        seconds = window
    else:
        m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", window.lower())
        if not m or m.group(2) not in _UNITS:
            raise ValueError(f"unsupported window {window!r}")
        seconds = int(m.group(1)) * _UNITS[m.group(2)]
    if seconds <= 0:
        raise ValueError("the window must be positive")
    return seconds


def _after(seconds: int) -> Column:
    """The window's length and one microsecond: when something has left."""
    return F.expr(f"make_dt_interval(0, 0, 0, CAST({seconds}.000001 AS DECIMAL(18,6)))")


# ---- users with many rows ----------------------------------------------------------
def _hot(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """(h_u): the users with more than ``bucket_rows`` rows, HOT_USERS of them at most."""
    counts = rows.groupBy(F.col("_u").alias("h_u")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > bucket_rows)
    return counts.orderBy(F.col("_rows").desc(), "h_u").limit(HOT_USERS).select("h_u")


def _may_be_hot(rows: DataFrame, bucket_rows: int) -> bool:
    """False where all files together are less than one scan task reads for
    ``bucket_rows`` rows: then no user's rows can be too many for one task."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return size > BYTES_A_ROW * bucket_rows


def _branches(rows: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the other users, in their users' partitions, and rows of the hot ones (None
    if the input is so small that there are none)."""
    if not _may_be_hot(rows, bucket_rows):
        return rows.repartition("_u"), None
    hot = F.broadcast(_hot(rows, bucket_rows))
    same = F.col("_u").eqNullSafe(F.col("h_u"))
    return rows.join(hot, same, "left_anti").repartition("_u"), rows.join(hot, same, "left_semi")


def _micros(time: Column) -> Column:
    """Microseconds since the epoch, zone-free for ``timestamp_ntz``. Spark's whole seconds
    are cut towards zero, so before 1970 a fraction belongs to the second before."""
    second = F.extract(F.lit("SECOND"), time)
    fraction = ((second - F.floor(second)) * 1_000_000).cast("bigint")
    early = (time < F.expr("TIMESTAMP_NTZ'1970-01-01'")) & (fraction > 0)
    return (F.unix_timestamp(time) - F.when(early, 1).otherwise(0)) * 1_000_000 + fraction


def _equal(pairs: list[tuple[str, str]]) -> Column:
    """All pairs of columns are equal, nulls too."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _grouped(rows: DataFrame, keys: list[str], bucket_rows: int) -> DataFrame:
    """``rows`` with ``_b``, the group of their time ``_t`` on the keys' time line."""
    cell = F.floor(_micros(F.col("_t")) / max(1, bucket_rows // 2)).cast("bigint")
    celled = rows.withColumn("_cell", cell)
    cells = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("_cell") / CELLS_PER_BLOCK))
    by = ", ".join(keys)
    blocks = (
        cells.groupBy(*[F.col(k).alias(f"b{k}") for k in keys], F.col("_block").alias("b_block"))
        .agg(F.sum("_n").alias("_sum"))
        .selectExpr(
            *[f"b{k}" for k in keys],
            "b_block",
            f"coalesce(sum(_sum) OVER (PARTITION BY {', '.join('b' + k for k in keys)} ORDER BY b_block"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before_block",
        )
    )
    in_block = f"coalesce(sum(_n) OVER (PARTITION BY {by}, _block ORDER BY _cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    numbered = cells.join(blocks, _equal([*[(k, f"b{k}") for k in keys], ("_block", "b_block")])).selectExpr(
        *[f"{k} AS c{k}" for k in keys], "_cell AS c_cell", f"floor((_before_block + {in_block}) / {bucket_rows}) AS _b"
    )
    pairs = [*[(k, f"c{k}") for k in keys], ("_cell", "c_cell")]
    return celled.join(numbered, _equal(pairs)).drop("_cell", *[b for _, b in pairs])


# ---- sweeps ------------------------------------------------------------------------
def _events(leaving: DataFrame, weight: str, asked: str) -> DataFrame:
    """(_u, _t, _d, _k): each row enters at _t and leaves at _leave; one event for each
    (user, time), with _k where something was asked at that time."""
    both = leaving.selectExpr(
        "_u", f"inline(array(struct(_t, {weight} AS _d, {asked} AS _k), struct(_leave AS _t, -{weight} AS _d, CAST(NULL AS BIGINT) AS _k)))"
    )
    return both.groupBy("_u", "_t").agg(F.sum("_d").alias("_d"), F.max("_k").alias("_k"))


def _swept(events: DataFrame) -> DataFrame:
    """Running sums over each user's events; (_u, _t, _k, _n) where something was asked."""
    run = events.selectExpr("_u", "_t", "_k", "sum(_d) OVER (PARTITION BY _u ORDER BY _t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _n")
    return run.where("_k IS NOT NULL")


def _swept_in_groups(events: DataFrame, bucket_rows: int) -> DataFrame:
    """As ``_swept``, for users whose events are cut into groups."""
    cut = _grouped(events, ["_u"], bucket_rows)
    start = (
        cut.groupBy(F.col("_u").alias("s_u"), F.col("_b").alias("s_b"))
        .agg(F.sum("_d").alias("_net"))
        .selectExpr("s_u", "s_b", "coalesce(sum(_net) OVER (PARTITION BY s_u ORDER BY s_b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _start")
    )
    run = cut.selectExpr("*", "sum(_d) OVER (PARTITION BY _u, _b ORDER BY _t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _run")
    return run.where("_k IS NOT NULL").join(start, _equal([("_u", "s_u"), ("_b", "s_b")])).selectExpr("_u", "_t", "_k", "_run + _start AS _n")


def _ranked(out: DataFrame, name: str, user: str, ts: str, ordered: bool, by_time_desc: bool = False) -> DataFrame:
    if not ordered:
        return out
    ties = [F.col(ts).desc(), F.col(user).asc()] if by_time_desc else [F.col(user).asc(), F.col(ts).asc()]
    return out.orderBy(F.col(name).desc(), *ties)


def _known(df: DataFrame, user: str, ts: str, *cols: str) -> DataFrame:
    return df.select(F.col(user).alias("_u"), F.col(ts).alias("_t"), *cols).where("_u IS NOT NULL AND _t IS NOT NULL")


def _instants(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_u", "_t").agg(F.count(F.lit(1)).alias("_k"))


# ---- trailing count ------------------------------------------------------------
def trailing_count(
    df: DataFrame,
    window: str | int = "1 hour",
    min_count: int = 5,
    *,
    name: str = "purchases_in_1h",
    user: str = "user_id",
    ts: str = "transaction_time",
    strategy: str = "bucketed",
    bucket_rows: int = BUCKET_ROWS,
    ordered: bool = True,
) -> DataFrame:
    """Per (user, t1): rows of the user in [t1 - window, t1], times the rows at t1;
    kept when >= ``min_count``."""
    w = window_seconds(window)
    known = _known(df, user, ts)
    if strategy == "window":
        frame = f"sum(_k) OVER (PARTITION BY _u ORDER BY _t RANGE BETWEEN INTERVAL '{w}' SECOND PRECEDING AND CURRENT ROW)"
        counted = _instants(known).selectExpr("_u", "_t", "_k", f"{frame} AS _n")
    elif strategy == "bucketed":
        calm, hot = _branches(known, bucket_rows)

        def events(rows: DataFrame) -> DataFrame:
            return _events(_instants(rows).withColumn("_leave", F.col("_t") + _after(w)), "_k", "_k")

        counted = _swept(events(calm))
        if hot is not None:
            counted = counted.union(_swept_in_groups(events(hot), bucket_rows))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = counted.selectExpr(f"_u AS `{user}`", f"_t AS `{ts}`", f"CAST(_k * _n AS BIGINT) AS `{name}`")
    return _ranked(out.filter(F.col(name) >= min_count), name, user, ts, ordered)


def small_purchases(
    tx: DataFrame,
    max_amount: float = 10,
    *,
    amount: str = "amount",
    type_col: str = "tx_type",
) -> DataFrame:
    """Purchases with 0 < amount <= ``max_amount`` (the card-testing input)."""
    a = F.col(amount)
    return tx.filter((F.col(type_col) == "purchase") & (a > 0) & (a <= max_amount))


# ---- trailing distinct ---------------------------------------------------------
def _leaving(occurrences: DataFrame, w: int, next_time: str) -> DataFrame:
    """Occurrences (_u, _v, _t) with the time they leave; a null value only asks."""
    return occurrences.withColumn("_leave", F.least(F.expr(next_time), F.col("_t") + _after(w)))


def _hot_leaving(occurrences: DataFrame, w: int, bucket_rows: int) -> DataFrame:
    """As ``_leaving``, where a (user, value) may have many rows: the next time is the next
    one in the group, else the first of the next group that has any."""
    cut = _grouped(occurrences, ["_u", "_v"], bucket_rows)
    firsts = (
        cut.groupBy(F.col("_u").alias("f_u"), F.col("_v").alias("f_v"), F.col("_b").alias("f_b"))
        .agg(F.min("_t").alias("_first"))
        .selectExpr("f_u", "f_v", "f_b", "lead(_first) OVER (PARTITION BY f_u, f_v ORDER BY f_b) AS _later")
    )
    soon = cut.selectExpr("*", "lead(_t) OVER (PARTITION BY _u, _v, _b ORDER BY _t) AS _soon")
    joined = soon.join(firsts, _equal([("_u", "f_u"), ("_v", "f_v"), ("_b", "f_b")]))
    return _leaving(joined, w, "coalesce(_soon, _later)").select("_u", "_v", "_t", "_leave")


def trailing_distinct(
    df: DataFrame,
    column: str,
    window: str | int = "24 hours",
    min_count: int = 2,
    *,
    name: str | None = None,
    user: str = "user_id",
    ts: str = "transaction_time",
    strategy: str = "bucketed",
    bucket_rows: int = BUCKET_ROWS,
    n: int | None = None,
    order_by_time_desc: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Per (user, t1): distinct non-null ``column`` values in [t1 - window, t1];
    kept when >= ``min_count``. With ``n``, the top ``n`` by count (ties by
    user, then time)."""
    name = name or f"{column}_in_window"
    w = window_seconds(window)
    known = _known(df, user, ts, F.col(column).alias("_v"))
    if strategy == "window":
        occurrences = known.distinct()
        frame = f"collect_set(_v) OVER (PARTITION BY _u ORDER BY _t RANGE BETWEEN INTERVAL '{w}' SECOND PRECEDING AND CURRENT ROW)"
        counted = occurrences.selectExpr("_u", "_t", f"size({frame}) AS _n").groupBy("_u", "_t").agg(F.max("_n").alias("_n"))
    elif strategy == "bucketed":
        calm, hot = _branches(known, bucket_rows)
        one, asked = "CAST(IF(_v IS NULL, 0, 1) AS BIGINT)", "CAST(1 AS BIGINT)"
        calm = _leaving(calm.distinct(), w, "lead(_t) OVER (PARTITION BY _u, _v ORDER BY _t)")
        counted = _swept(_events(calm, one, asked))
        if hot is not None:
            leaving = _hot_leaving(hot.distinct(), w, bucket_rows)
            counted = counted.union(_swept_in_groups(_events(leaving, one, asked), bucket_rows))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = counted.selectExpr(f"_u AS `{user}`", f"_t AS `{ts}`", f"CAST(_n AS BIGINT) AS `{name}`").filter(F.col(name) >= min_count)
    if n is not None:
        return _ranked(out, name, user, ts, True).limit(n)
    return _ranked(out, name, user, ts, ordered, order_by_time_desc)


def _hot_pairs(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """(_u, _prev, _t): each row with the one before, of users whose rows are cut into groups."""
    chunk = F.floor(F.monotonically_increasing_id() / ROWS_PER_CHUNK).alias("_chunk")
    chunks = rows.select("_u", "_t", chunk).groupBy("_u", "_t", "_chunk").agg(F.count(F.lit(1)).cast("int").alias("_k"))
    cut = _grouped(chunks, ["_u"], bucket_rows)
    lasts = (
        cut.groupBy(F.col("_u").alias("l_u"), F.col("_b").alias("l_b"))
        .agg(F.max("_t").alias("_last"))
        .selectExpr("l_u", "l_b", "lag(_last) OVER (PARTITION BY l_u ORDER BY l_b) AS _before")
    )
    return (
        cut.selectExpr("*", "lag(_t) OVER (PARTITION BY _u, _b ORDER BY _t, _chunk) AS _near")
        .join(lasts, _equal([("_u", "l_u"), ("_b", "l_b")]))
        .selectExpr("_u", "_t", "coalesce(_near, _before) AS _prev", "posexplode(array_repeat(0, _k)) AS (_i, _zero)")
        .selectExpr("_u", "IF(_i = 0, _prev, _t) AS _prev", "_t")
    )


# ---- consecutive gaps ------------------------------------------------------------
def consecutive_gap(
    events: DataFrame,
    max_hours: float = 48,
    *,
    user: str = "user_id",
    ts: str = "transaction_time",
    bucket_rows: int = BUCKET_ROWS,
    ordered: bool = True,
) -> DataFrame:
    """Pairs of consecutive events of a user at most ``max_hours`` apart.

    Output: user, prev_cb_time, transaction_time, hours_diff (whole seconds /
    3600). Events at one time are each other's predecessors with a gap of 0. Null users
    are a user like any other; null times are dropped.

    A hot user's events at one time are counted in chunks of at most ROWS_PER_CHUNK rows
    before they move. The previous event is the one before in the group, or the last of
    the nearest earlier group that has any: one time per group.
    """
    dated = events.select(F.col(user).alias("_u"), F.col(ts).alias("_t")).where("_t IS NOT NULL")
    calm, hot = _branches(dated, bucket_rows)
    pairs = calm.selectExpr("_u", "lag(_t) OVER (PARTITION BY _u ORDER BY _t) AS _prev", "_t")

    if hot is not None:
        pairs = pairs.union(_hot_pairs(hot, bucket_rows))
    out = (
        pairs
        .selectExpr(f"_u AS `{user}`", "_prev AS prev_cb_time", f"_t AS `{ts}`")
        .where("prev_cb_time IS NOT NULL")
        .selectExpr("*", f"CAST(unix_timestamp(`{ts}`) - unix_timestamp(prev_cb_time) AS DOUBLE) / 3600.0D AS hours_diff")
        .where(f"hours_diff <= {float(max_hours)!r}")
    )
    return out.orderBy(F.col("hours_diff").asc(), F.col(ts).desc(), F.col(user).asc()) if ordered else out
