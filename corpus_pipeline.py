"""A corpus in five steps: rules, repeated lines, near copies, source weights, fixed-length sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again for the next. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import durable, free_names
from factloom.llm.line_dedup import dedup_lines
from factloom.llm.minhash_dedup import keep_one
from factloom.llm.mixing import mixed_texts
from factloom.llm.packing import pack_documents
from factloom.llm.quality_rules import quality_rules
from factloom.llm.queries import BYTE_MODEL, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts go, with all others of fewer than 50 words; repeated rows and null ids are judged like others. An empty table
    gives an empty one. All columns stay as they are, whatever their names.
    """
    quality, passed = free_names(docs.columns, "quality", "passed")
    judged = quality_rules(docs, into=quality)
    # a generator, where a filter would be pushed below the rules' projections and compute them over and over
    kept = F.explode(F.when(F.col(f"{quality}.kept"), F.array(F.lit(True))))
    return judged.select(*[f"`{c}`" for c in docs.columns], kept.alias(passed)).drop(passed)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose windows occurred before; those of which no line is left go.

    Null and empty texts lose no line and stay. Rows that repeat lose no lines to each other; null ids come after all others, so they
    lose the lines. ``n_chars``, where present, is the length of a text that changed. An empty table gives an empty one. All columns
    stay, whatever their names.
    """
    (lines,) = free_names(docs.columns, "lines")
    done = dedup_lines(docs, into=lines).where(F.col(f"{lines}.n_removed") < F.greatest(F.col(f"{lines}.n_lines"), F.lit(1)))
    names = {c.lower(): c for c in docs.columns}
    done = done.withColumn(names["text"], F.col(f"{lines}.kept"))
    if "n_chars" in names:
        n = names["n_chars"]
        done = done.withColumn(n, F.when(F.col(f"{lines}.n_removed") > 0, F.length("text").cast(docs.schema[n].dataType)).otherwise(F.col(n)))
    return done.select(*[f"`{c}`" for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the least id's: five-word shingles, similarity 0.8 or more.

    Null and empty texts are in no group and stay. Of rows equal in id and text one stays, of those without an id all. An empty table
    gives an empty one. All columns stay, whatever their names.
    """
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the source weights take, as documents: a row for each time that one is taken.

    Null and empty texts have no words to take and go. Null sources and ids are values like others, repeated rows are documents of
    their own. An empty table gives an empty one. All columns stay, whatever their names.
    """
    return mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents in sequences.

    Null and empty texts are one piece that holds the closing id; null ids and repeated rows are packed like others. An empty table
    gives an empty one. Other columns are not read.
    """
    return pack_documents(docs, tokenizer_path(BYTE_MODEL))


STAGES = [("quality_rules", keep_good), ("line_dedup", drop_lines), ("minhash_dedup", drop_copies), ("source_mixing", mix), ("best_fit_packing", pack)]
#: The draws of the mix and the order of packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
