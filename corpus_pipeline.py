"""From raw documents to tokens, in five stages.

1. quality: documents that the classifier finds poor or toxic go;
2. exact dedup: of equal texts one row stays;
3. near dedup: of each component of documents whose sets of five-word shingles are
   alike by 0.8 or more, one stays; documents without words are linked with nothing and
   all stay;
4. mixing: a document is there once for each pass that takes it;
5. tokens: ids of every document that is left.

A stage's decisions are a narrow table; the documents are joined with it by all columns
that the decision depends on (id and hash of the text; site; source). Where one of several
rows equal in id and text stays, it is the one whose columns have the least hash, taken
by an aggregate that is partial in the scan tasks. So each surviving row is a row of the
input, and which one does not depend on partitioning.

All stages but the last return the columns of their input, whatever extra ones it has.
Null ids and texts, repeated rows, very long texts and empty tables are handled as each
operator's docstring says: nothing is cut or left out for its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paylens.llm import bpe_codec, content_sort_dedup, hamming_join, mixing, quality
from paylens.llm.content_sort_dedup import BLANKS
from paylens.llm.queries import vocabulary
from paylens.llm.workspace import Workspace, drop_since, mark

#: The stages train a model and follow links between whole sets: no SQL says the same.
ORACLE_SQL = None


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """(_doc_id, _text_hash, _<column>..., _row): the rows and what decisions are joined on."""
    return docs.select(
        docs["doc_id"].cast("bigint").alias("_doc_id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_text_hash"),
        *[docs[c].alias(f"_{c}") for c in columns],
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
    )


def _same(pairs: dict[str, str]) -> F.Column:
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


_BY_TEXT = {"_doc_id": "doc_id", "_text_hash": "text_hash"}


def _one_of_each(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_hash) of ``taken``."""
    rows = _keyed(docs).groupBy("_doc_id", "_text_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return rows.join(taken.select("doc_id", "text_hash").distinct(), _same(_BY_TEXT), "left_semi").select("_row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    kept = quality.classify(docs, labels).where("kept").select("doc_id", "text_hash", "host", "path").distinct()
    site = _BY_TEXT | {"_source": "host", "_lang": "path"}
    return _keyed(docs, "source", "lang").join(kept, _same(site), "left_semi").select("_row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each(docs, content_sort_dedup.exact_groups(docs).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    body = F.coalesce(docs["text"], F.lit(""))
    has_words = F.trim(body, F.lit(BLANKS)) != ""
    found = hamming_join.near_components(docs.where(has_words), percent=80)
    return _one_of_each(docs.where(has_words), found.where("chosen")).union(docs.where(~has_words))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counts = mixing.mix(docs).groupBy("doc_id", "text_hash", "source", "passes").agg(F.count(F.lit(1)).alias("rows"))
    # rows of one key differ only where the draw ends among them: more passes come first
    plans = counts.groupBy("doc_id", "text_hash", "source").agg(F.sort_array(F.collect_list(F.struct("passes", "rows")), asc=False).alias("plan"))
    rows = _keyed(docs, "source").join(plans, _same(_BY_TEXT | {"_source": "source"}))
    alike = rows.where(F.size("plan") == 1).select("_row", F.get("plan", F.lit(0))["passes"].alias("passes"))
    nth = F.row_number().over(W.partitionBy("_doc_id", "_text_hash", "_source").orderBy(F.xxhash64("_row")))
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("passes"))
    at = F.aggregate(
        "plan",
        start,
        lambda a, x: F.struct(
            (a["upto"] + x["rows"]).alias("upto"),
            F.when(a["passes"].isNull() & (F.col("_nth") <= a["upto"] + x["rows"]), x["passes"]).otherwise(a["passes"]).alias("passes"),
        ),
    )
    split = rows.where(F.size("plan") > 1).withColumn("_nth", nth).select("_row", at["passes"].alias("passes"))
    taken = alike.union(split).where("passes > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("passes").cast("int"))).alias("_copy")).select("_row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(docs, vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written and read again, and
    what only a finished stage needed is deleted. The last stage's input stays."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = ""
    for name, stage in STAGES[:-1]:
        point = mark()
        docs = ws.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_since(spark, point)
        if before:
            ws.drop(before)
        before = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
