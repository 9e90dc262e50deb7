"""Column listing of a table: position, name, SQL type, and whether it holds nulls.

Parquet files and DataFrames carry no NOT NULL constraints, so the flag is read
from the rows: one aggregate counts the nulls of every column. Declared
constraints are checked by ``operators.quality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

# ---- fixed values: SQL names of Spark types ----
_SQL_NAMES = {
    LongType: "BIGINT",
    IntegerType: "INTEGER",
    ShortType: "SMALLINT",
    DoubleType: "DOUBLE",
    FloatType: "FLOAT",
    StringType: "VARCHAR",
    BooleanType: "BOOLEAN",
    DateType: "DATE",
    TimestampNTZType: "TIMESTAMP",
    TimestampType: "TIMESTAMP WITH TIME ZONE",
}


def sql_type_name(t: DataType) -> str:
    if isinstance(t, DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return _SQL_NAMES.get(type(t), t.simpleString().upper())


def describe(df: DataFrame) -> DataFrame:
    """(cid, name, type, not_null, row_count) per column of ``df``; ``not_null`` is 1
    for a column without nulls."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.expr(f"count_if(`{c}` IS NULL)").alias(f"_{c}") for c in df.columns])
    columns = F.array(
        *[
            F.struct(
                F.lit(i).alias("cid"),
                F.lit(f.name).alias("name"),
                F.lit(sql_type_name(f.dataType)).alias("type"),
                F.when(F.col(f"_{f.name}") == 0, 1).otherwise(0).alias("not_null"),
                F.col("_rows").alias("row_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return counts.select(F.inline(columns))
