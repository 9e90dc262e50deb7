"""Column-expression helpers; all are built-in Spark expressions (codegen, no UDF)."""

from paylens.functions.exprs import (
    MONEY,
    MONEY_SUM,
    count_where,
    days_between,
    epoch_seconds,
    hours_between,
    mean_exact,
    money,
    ratio,
    sum_flag,
    sum_money,
    sum_where,
)

__all__ = [
    "MONEY",
    "MONEY_SUM",
    "count_where",
    "days_between",
    "epoch_seconds",
    "hours_between",
    "mean_exact",
    "money",
    "ratio",
    "sum_flag",
    "sum_money",
    "sum_where",
]
