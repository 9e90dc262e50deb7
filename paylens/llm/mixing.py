"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word target. A target above the source's size is met by
complete passes over the source first; what is left is drawn without replacement,
each document by the key ``-ln(u) / quality``: the smallest keys win, so a
document of twice the quality is twice as likely to come first. ``u`` is a hash of
the document's id, of its text where the id is null, so reruns agree.

The draw is a prefix sum in key order. A hot source is cut into key intervals;
sums per (source, interval) give each interval's start, and the running sum inside
an interval is local. Nothing wider than an id and a few numbers is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm.workspace import Workspace

# ---- fixed values: ASCII white space, and characters that running prose seldom has ----
WORD = r"[^\x20\x09-\x0D]+"
ODD_CHARS = "0123456789#$%&*+/<=>@\\^_`{|}~"


def prose_quality(text: Column) -> Column:
    """A document's weight, 0.05 to 1: the share of characters usual in prose."""
    kept = F.length(F.translate(text, ODD_CHARS, ""))
    return F.lit(0.05) + F.lit(0.95) * kept / F.greatest(F.length(text), F.lit(1))


def uniform(doc_id: Column, text_md5: Column, seed: str) -> Column:
    """A number in (0, 1) that the id decides, or the text's MD5 if it is null: 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), text_md5))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size) -> also target, epochs, rest.

    Sources in code point order, null last, have the weights in turn. All targets
    add up to ``share`` of all sizes; none passes ``most`` times its source's size.
    Giving capped sources' excess to the others by weight, until none is above,
    ends at one level per unit of weight. Sorting by size per weight finds it: the
    first source whose share at the level of those from it on fits its cap. The
    window runs over one row per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int"))
    by_fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    out = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_from"))
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    )
    # levels fall from the first that fits on, ties included
    first = F.max("fits").over(everything)
    out = out.withColumn("target", F.least(F.col("cap"), F.coalesce(first * F.col("weight"), F.col("cap"))))
    out = out.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    )
    return out.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select(
        "source", "source_size", "target", "epochs", "rest"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    intervals: int = 4096,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    quality: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, passes, taken, text_hash.

    ``size`` counts words (null text: 0); ``taken`` is size times ``passes``, the passes
    that take the document: ``epochs`` complete ones, and one more for those drawn. The
    draw stops where the running sum is nearest to the rest of the target, so a
    source misses it by half a document at most. ``quality`` weighs documents
    (default: ``prose_quality``); below 0.000001 or null counts as that.

    Null sources form a source of their own. Rows with null ids are drawn by their texts.
    Ties of the key are ordered by id, size and the MD5 of the text; rows equal in all of
    them and in the source are interchangeable, so the result does not depend on how the
    rows are dealt out. Texts of any length count whole. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    body = F.coalesce(F.col(text), F.lit(""))
    worth = F.coalesce(quality if quality is not None else prose_quality(body), F.lit(0.0)).cast("double")
    rows = ws.table(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("size"),
            (-F.log(uniform(F.col(doc_id), F.md5(body.cast("binary")), seed)) / F.greatest(worth, F.lit(1e-6))).alias("key"),
            F.xxhash64(body).alias("text_hash"),
            F.md5(body.cast("binary")).alias("tie"),
        ).withColumn("step", F.floor((1 - F.exp(-F.col("key"))) * intervals).cast("int")),
        "rows",
    )
    steps = rows.groupBy("source", "step").agg(F.sum("size").alias("step_size"))
    targets = source_targets(steps.groupBy("source").agg(F.sum("step_size").alias("source_size")), weights, share, most)
    before = W.partitionBy("source").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    starts = steps.withColumn("start", F.coalesce(F.sum("step_size").over(before), F.lit(0)))
    starts = starts.join(targets.withColumnRenamed("source", "src"), F.col("source").eqNullSafe(F.col("src")))
    starts = starts.select(F.col("src"), F.col("step").alias("st"), "start", "source_size", "target", "epochs", "rest")
    inside = W.partitionBy("source", "step").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.withColumn("upto", F.sum("size").over(inside))
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("src")) & (F.col("step") == F.col("st")))
    drawn = F.col("start") + F.col("upto") - F.col("size") / 2 <= F.col("rest")
    passes = (F.col("epochs") + F.when(drawn & (F.col("rest") > 0), 1).otherwise(0)).cast("bigint")
    return joined.withColumn("passes", passes).select(
        "doc_id", "size", "source", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"), "text_hash"
    )
