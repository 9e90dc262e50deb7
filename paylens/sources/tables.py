"""Reading and writing tables.

Reads are plain ``spark.read.parquet`` so Catalyst prunes columns and pushes
filters into the scan (``ReadSchema`` / ``PushedFilters`` in the plan). Writes
go to a folder on shared storage; callers pass table folders, never
machine-local paths.

``load_rows`` is ``INSERT INTO`` for a declared table: values are cast to the declared
types, rows that do not fit are set aside with their reasons, and the others are
appended as one batch, exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, root: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Scan one table of a dataset folder (``<root>/<name>.parquet``).

    Without ``schema`` it is read from the files each time, so a table written
    anew with other columns is seen as it is.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table_path(root, name))


def create_table(spark: SparkSession, name: str, path: str, schema: StructType) -> DataFrame:
    """``CREATE TABLE name (...) USING parquet LOCATION path``: a catalog table
    with a fixed schema over a shared folder; rows arrive via ``append_table``
    and are seen after ``refresh_table``."""
    return spark.catalog.createTable(name, path=path, source="parquet", schema=schema)


def refresh_table(spark: SparkSession, name: str) -> None:
    """Pick up files appended to a catalog table's folder since it was read."""
    spark.catalog.refreshTable(name)


def rows_to_frame(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Rows given as literals (the seed inserts of the analyses) -> DataFrame.

    Meant for small fixtures; bulk loads go through ``append_table``.
    """
    return spark.createDataFrame(rows, schema)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """``INSERT INTO`` at scale: append the rows as new Parquet files."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace a table folder with the rows of ``df``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


# ---- batches, exactly once --------------------------------------------------------------
BATCH = "load_batch"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def batch_is_loaded(spark: SparkSession, path: str, batch_id: str) -> bool:
    return path_exists(spark, f"{path.rstrip('/')}/{BATCH}={batch_id}")


def _write_batch(df: DataFrame, path: str, batch_id: str) -> None:
    if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id):
        raise ValueError("a batch id holds letters, digits, '-', '_' and '.'")
    marked = df.withColumn(BATCH, F.lit(batch_id))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: str) -> bool:
    """Append the rows of ``df`` to a table as the batch ``batch_id``, once.

    The rows are staged in a hidden folder; the end of the job renames it to the batch's
    own folder. A load that fails before leaves nothing that readers see, and may be run
    again. A batch that is there already is not read or written again: returns False. A
    batch without rows leaves no folder. One loader at a time may work on a batch.
    """
    if batch_is_loaded(df.sparkSession, path, batch_id):
        return False
    _write_batch(df, path, batch_id)
    return True


def read_batches(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All rows of a table of batches, without the batch column."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField(BATCH, StringType())]))
    return reader.parquet(path).drop(BATCH)


# ---- declared schemas ---------------------------------------------------------------------
def conformed(df: DataFrame, schema: StructType) -> DataFrame:
    """The declared columns with their declared types, ``_reasons`` (why the row does not
    fit; empty if it does) and ``_row`` (the row as it came, as JSON).

    A value that its type cannot hold, and a null in a NOT NULL column, are reasons. Columns
    that are not declared are in ``_row`` only; a declared one that is missing is an error.
    """
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    values, reasons = [], []
    for f in schema.fields:
        came, kind = F.col(f.name), f.dataType.simpleString()
        value = came.try_cast(f.dataType)
        values.append(value.alias(f.name))
        reasons.append(F.when(came.isNotNull() & value.isNull(), F.lit(f"{f.name}: no {kind}")))
        if not f.nullable:
            reasons.append(F.when(came.isNull(), F.lit(f"{f.name}: null")))
    found: Column = F.array_compact(F.array(*reasons))
    return df.select(*values, found.alias("_reasons"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_row"))


def load_rows(df: DataFrame, schema: StructType, path: str, rejects: str, batch_id: str) -> bool:
    """Load a batch into the declared table at ``path``; rows that do not fit go to the
    table ``rejects`` (_row, _reasons), so every row is in one of the two, once.

    The rejects are written first and replace those of an earlier, unfinished load of the
    batch; the good rows' commit ends the load. Returns False if the batch is there.
    """
    if batch_is_loaded(df.sparkSession, path, batch_id):
        return False
    checked = conformed(df, schema)
    _write_batch(checked.where(F.size("_reasons") > 0).select("_row", "_reasons"), rejects, batch_id)
    return append_batch(checked.where(F.size("_reasons") == 0).select(*schema.fieldNames()), path, batch_id)
