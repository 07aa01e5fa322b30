"""The corpus operators over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRETOKEN_MODEL, BYTE_MODEL = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """Where the tokenizer file lies; FACTLOOM_TOKENIZERS names another folder."""
    if folder := os.environ.get("FACTLOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    done = dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2("lines.kept", 256).alias("kept_sha256"))


def op6_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived_pages

    return archived_pages(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(PRETOKEN_MODEL)).withColumn("over_limit", F.col("n_tokens") > 2048)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", "quality.*")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_MODEL))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the mix no draw decides: sizes and targets, to a thousandth of a word."""
    from .mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)} | {"mix_targets": mix_targets}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLES)
