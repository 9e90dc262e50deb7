"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm import bpe_codec, content_sort_dedup, conversation_repair, crf_language, hamming_join, hilbert_shards, mixing, multiset_hash, quality, suffix_levels, token_counts, vector_codes, wacz
from paylens.llm.oracle import ORACLE


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{table}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(_read(spark, sf_dir, "documents"), shards=24, law="rows")


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprints(_read(spark, sf_dir, "documents"))


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup.exact_groups(_read(spark, sf_dir, "documents")).drop("text_hash")


def vocabulary() -> str:
    """The public tokenizer file the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(_read(spark, sf_dir, "documents"), vocabulary())


def op5_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = wacz.archive_round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_join.near_components(_read(spark, sf_dir, "documents")).drop("text_hash", "chosen")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("text_hash", "host", "path")


def op9_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.repeated_spans(_read(spark, sf_dir, "documents")).drop("removed")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), vocabulary())


def op11_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = crf_language.train(docs.where(~held_out))
    return crf_language.identify(docs, model, keep=(docs["doc_id"], held_out.alias("held_out")))


def op12_hirschberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    found = conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(rows)))
    ids = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *counts, *texts)


def op13_drake_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(_read(spark, sf_dir, "embeddings"))
    sums = codes.groupBy(F.col("label").alias("s_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("s_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_multiset_hash": op2_multiset_hash,
    "op3_content_sort": op3_content_sort,
    "op4_bpe_transducer": op4_bpe_transducer,
    "op5_wacz": op5_wacz,
    "op6_hamming_join": op6_hamming_join,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_suffix_levels": op9_suffix_levels,
    "op10_token_counts": op10_token_counts,
    "op11_crf": op11_crf,
    "op12_hirschberg": op12_hirschberg,
    "op13_drake_hamerly": op13_drake_hamerly,
}

__all__ = ["ORACLE", "QUERIES", "vocabulary"]
