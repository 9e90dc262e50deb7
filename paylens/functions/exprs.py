"""Expression helpers with the exact null and type rules the operators need.

* ``count_where``  = ``COUNT(*) FILTER (WHERE c)``: 0 on empty input, a null
  condition counts as false.
* ``sum_flag``     = ``SUM(CASE WHEN c THEN 1 ELSE 0 END)``: null on empty input.
* ``sum_where``    = ``SUM(x) FILTER (WHERE c)``: null when nothing matches.
* ``ratio``        = ``CAST(a AS DOUBLE) / NULLIF(b, 0)``: null instead of a
  division error (ANSI mode raises on / 0).
* ``epoch_seconds``: whole epoch seconds, fractions floored; zone-free for
  ``timestamp_ntz``.
* Money is ``decimal(18,2)``; money sums are returned as ``decimal(38,2)`` so the
  result type does not depend on the engine's widening rule, and sums are exact
  regardless of the order partial aggregates are merged in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 2)
MONEY_SUM = DecimalType(38, 2)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Cast an amount to ``decimal(18,2)``."""
    return _col(c).cast(MONEY)


def count_where(cond: Column) -> Column:
    """``COUNT(*) FILTER (WHERE cond)`` -> bigint, 0 when nothing matches."""
    return F.count_if(cond)


def sum_flag(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` -> bigint, null on empty input."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def sum_where(x: Column | str, cond: Column) -> Column:
    """``SUM(x) FILTER (WHERE cond)`` -> null when no row matches."""
    return F.sum(F.when(cond, _col(x)))


def sum_money(x: Column | str) -> Column:
    """Exact money sum as ``decimal(38,2)``."""
    return F.sum(_col(x)).cast(MONEY_SUM)


def mean_exact(x: Column | str) -> Column:
    """Mean of an exact (decimal) column as double: exact sum / non-null count.

    The sum is exact, so the result does not depend on partition order; a
    group with no non-null value gives null.
    """
    c = _col(x)
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``CAST(numerator AS DOUBLE) / NULLIF(denominator, 0)``."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0))


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since the epoch, fractions floored (bigint)."""
    return F.unix_timestamp(_col(ts))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Hours from ``earlier`` to ``later`` over whole seconds, as double."""
    return (epoch_seconds(later) - epoch_seconds(earlier)) / F.lit(3600.0)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole days from ``earlier`` to ``later`` (dates), as int."""
    return F.datediff(_col(later), _col(earlier))
