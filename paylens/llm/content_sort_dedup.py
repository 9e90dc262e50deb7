"""Exact deduplication by sorting contents.

Normalised texts are range-partitioned at cut points taken from a sample, sorted
inside each range, and compared with their neighbour in full; a run of equal
neighbours is a group. Runs that go on in the next range are joined by comparing
the texts on both sides of each cut.

The sort key is (first characters, digest, whole text, id, tie). Cut points hold the
first characters, the digest, an id and a tie, so their size is bounded, and a text with
a third of all rows is cut by id into as many ranges as it fills; where the ids are null
too, by the tie, a hash of the row's place in its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.ranges import range_bucket
from paylens.llm.workspace import Workspace, partitions

# ---- fixed values: the characters that normalisation deletes ----
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

HEAD = 64
SAMPLE_PER_RANGE = 30


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Texts are equal when identical without blanks (null counts as empty). Of equal
    texts the row with the most code points in its original text stays, then the
    smallest id; a null id counts as greater than any other. Of repeated rows (same
    id, same text length) one stays, of rows with null ids one that its place decides.
    Texts of any length are compared whole; the two at the ends of a range are also kept
    for the comparison across the cut. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    base = _keys(docs, doc_id, text)
    n = partitions(spark)
    cuts = _cuts(docs, doc_id, text, n)
    key = F.struct("head", "sha", "id_key", "tie")
    known = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(s).alias("sha"), F.lit(i).alias("id_key"), F.lit(t).alias("tie")) for h, s, i, t in cuts])
    ranged = base.withColumn("part", range_bucket(key, known, len(cuts))).repartitionById(n, F.col("part"))
    order = W.partitionBy("part").orderBy("head", "sha", "norm", "id_key", "tie", "n_points")
    same = F.col("norm") == F.lag("norm").over(order)
    rows = ws.table(
        ranged.withColumn("same", F.coalesce(same, F.lit(False)))
        .withColumn(
            "again",
            F.col("same") & (F.lag("id_key").over(order) == F.col("id_key")) & (F.lag("tie").over(order) == F.col("tie"))
            & (F.lag("n_points").over(order) == F.col("n_points")),
        )
        .withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("is_first", F.row_number().over(order) == 1)
        .withColumn("is_last", F.lead("part").over(order).isNull())
        .select(
            "doc_id", "id_key", "tie", "n_points", "text_hash", "sha", "part", "run", "again", "is_first", "is_last",
            F.when(F.col("is_first") | F.col("is_last"), F.col("norm")).alias("edge"),
        ),
        "rows",
    )
    runs = rows.groupBy("part", "run").agg(
        F.min(F.struct((-F.col("n_points")).alias("minus"), F.col("id_key"), F.col("tie"))).alias("best"), F.count("*").alias("n")
    )
    runs = runs.join(_continued(rows), ["part", "run"], "left").select(
        "part", "run", "best", "n", F.coalesce("to_part", "part").alias("g_part"), F.coalesce("to_run", "run").alias("g_run")
    )
    groups = runs.groupBy("g_part", "g_run").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    runs = runs.select("part", "run", "g_part", "g_run").join(groups, ["g_part", "g_run"]).drop("g_part", "g_run")
    keep = F.col("best.id_key")
    return rows.drop("edge").join(runs, ["part", "run"]).select(
        "doc_id",
        F.when(keep != (1 << 63) - 1, keep).alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        ((F.col("id_key") == keep) & (F.col("tie") == F.col("best.tie")) & (F.col("n_points") == -F.col("best.minus")) & ~F.col("again")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "text_hash",
    )


def _keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows with normalised text and sort key."""
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.xxhash64(F.monotonically_increasing_id())
    return (
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"),
            F.length(body).alias("n_points"),
            F.xxhash64(body).alias("text_hash"),
            F.translate(body, BLANKS, "").alias("norm"),
            F.when(F.col(doc_id).isNull(), place).otherwise(0).alias("tie"),
        )
        .withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
        .withColumn("head", F.substring("norm", 1, HEAD))
        .withColumn("id_key", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)))
    )


def _cuts(docs: DataFrame, doc_id: str, text: str, n: int) -> list[tuple]:
    """n - 1 sort keys from a sample of at most about SAMPLE_PER_RANGE keys a range; only
    the sampled texts are normalised and hashed for it."""
    if n <= 1:
        return []
    count = docs.count()
    if not count:
        return []
    share = min(1.0, SAMPLE_PER_RANGE * n / count)
    seen = _keys(docs.sample(share, seed=11) if share < 1 else docs, doc_id, text).select("head", "sha", "id_key", "tie")
    keys = sorted((r["head"].encode(), r["sha"], r["id_key"], r["tie"]) for r in seen.collect())
    cuts = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    return [(h.decode(), s, i, t) for h, s, i, t in cuts]


def _continued(rows: DataFrame) -> DataFrame:
    """(part, run) of each range's first run that goes on from the range before,
    with the (to_part, to_run) where its group begins. One row per range."""
    edges = (
        rows.filter("is_first or is_last")
        .groupBy("part")
        .agg(
            F.max("run").alias("last_run"),
            F.max(F.when(F.col("is_first"), F.col("edge"))).alias("first_text"),
            F.max(F.when(F.col("is_last"), F.col("edge"))).alias("last_text"),
        )
    )
    by_part = W.orderBy("part")
    goes_on = F.coalesce(F.lag("last_text").over(by_part) == F.col("first_text"), F.lit(False))
    edges = edges.withColumn("goes_on", goes_on).withColumn("through", F.col("goes_on") & (F.col("last_run") == 1))
    began = F.last(F.when(~F.col("through"), F.struct("part", "last_run")), ignorenulls=True).over(
        by_part.rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        edges.withColumn("began", began)
        .filter("goes_on")
        .select("part", F.lit(1).cast("bigint").alias("run"), F.col("began.part").alias("to_part"), F.col("began.last_run").alias("to_run"))
    )
