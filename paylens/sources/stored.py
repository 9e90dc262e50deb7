"""Stored forms of a dataset that save its joins their shuffles.

* ``store_bucketed``: the ledger tables bucketed and sorted by the key they are joined on,
  so that open balances and debts join and group without an exchange.
* ``stored_matches``: the receivables' match relation, written once for a state of its
  input files. Eight reports then scan one narrow table instead of joining three. The
  state is the number, names, sizes and times of the files, taken from the file listing;
  another state is another folder, so a changed input is seen by the next call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.operators.matching import matched
from paylens.sources.adapters import Dataset
from paylens.sources.tables import path_exists, table_path

#: Tables and the key that their joins use.
BUCKET_KEYS = {
    "bills": "bill_id",
    "payment_applications": "bill_id",
    "invoices": "invoice_id",
    "cash_applications": "invoice_id",
    "payments": "payment_id",
}


class BucketedDataset(Dataset):
    """A dataset whose bucketed tables are read from the catalog, others as before."""

    def __init__(self, spark: SparkSession, root: str, prefix: str, tables: tuple[str, ...]):
        super().__init__(spark, root)
        for name in tables:
            setattr(self, name, lambda name=name: self.spark.table(f"{prefix}_{name}"))


def store_bucketed(dataset: Dataset, target: str, prefix: str, buckets: int, tables: tuple[str, ...] = tuple(BUCKET_KEYS)) -> BucketedDataset:
    """Write tables of ``dataset`` below ``target`` (a shared folder) in ``buckets`` files by
    their join key and register them as ``<prefix>_<table>``.

    The number of buckets is the number of tasks of the joins: table size over the bytes
    that a task should sort. A hot key fills one bucket; keys here are documents.
    """
    for name in tables:
        key = BUCKET_KEYS[name]
        rows = getattr(dataset, name)().repartition(buckets, key)
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", table_path(target, name)).saveAsTable(f"{prefix}_{name}")
    return BucketedDataset(dataset.spark, dataset.root, prefix, tables)


def open_bucketed(spark: SparkSession, root: str, target: str, prefix: str, buckets: int, tables: tuple[str, ...] = tuple(BUCKET_KEYS)) -> BucketedDataset:
    """The dataset of an earlier ``store_bucketed``, in a session whose catalog lacks its tables."""
    for name in tables:
        key, path = BUCKET_KEYS[name], table_path(target, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {prefix}_{name} ({columns}) USING parquet"
            f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
    return BucketedDataset(spark, root, prefix, tables)


def files_state(spark: SparkSession, paths: list[str]) -> str:
    """A text that changes when files below ``paths`` come, go or are written anew. Only
    the listing is read, and summed up by Spark."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    marks = [F.sum(F.xxhash64(F.lit(i), "path", "length", "modificationTime").cast("decimal(38,0)")) for i in range(2)]
    n, *sums = listed.agg(F.count(F.lit(1)), *marks).first()
    return "-".join([str(n), *(f"{int(s or 0) & (1 << 64) - 1:016x}" for s in sums)])


class MatchedDataset(Dataset):
    """A dataset whose receivables reports read a stored match relation."""

    def __init__(self, base: Dataset, matches: str):
        super().__init__(base.spark, base.root)
        self._base, self._matches = base, matches

    def __getattribute__(self, name: str):
        own = object.__getattribute__(self, "__dict__")
        if name in Dataset.DOMAIN_TABLES or name == "customer_names":
            return getattr(own["_base"], name)
        return object.__getattribute__(self, name)

    def match_inputs(self) -> tuple[DataFrame, None, None]:
        return self.spark.read.parquet(self._matches), None, None


def stored_matches(dataset: Dataset, folder: str) -> MatchedDataset:
    """``dataset`` with its match relation in ``folder`` (on shared storage), which is built
    if it is not there for the present state of the files it comes from.

    Building is a job, and committed by Spark's success file: one that fails is built
    again. Relations of earlier states stay until someone deletes their folders.
    """
    files = sorted({f for t in dataset.match_inputs() for f in t.inputFiles()})
    where = sorted({f.rsplit("/", 1)[0] if "/" in f else f for f in files}) if len(files) > 100 else files
    path = f"{folder.rstrip('/')}/matches-{files_state(dataset.spark, where)}"
    if not path_exists(dataset.spark, f"{path}/_SUCCESS"):
        matched(*dataset.match_inputs()).write.mode("overwrite").parquet(path)
    return MatchedDataset(dataset, path)
