"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, and a mix of sources.

Each stage takes all that the one before kept and is written as Parquet before the next reads it. Stages work on tables of
any columns that hold doc_id, text and source, and decide by row: rows that repeat an id or have none are told apart by
their texts, and of equal rows the near-duplicate stage keeps one. Null ids count as the largest id. Null and empty texts,
ties, long texts and empty tables are treated as the operators' modules say. The last stage adds its figures in columns
whose prefix no other column has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duetframe.llm import decontam, line_dedup, mixing, quality_rules, simhash
from duetframe.llm.common import materialize, table
from duetframe.storage import temporary_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; a document that loses all its lines stays with an empty text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity of 0.8 or more)."""
    return simhash.drop_near_duplicates(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each once, with its own size, source_size, target, taken and copies (named mix_...)."""
    prefix = "mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = mixing.mixed_rows(docs)
    return found.select("row.*", *[F.col(f"mix.{c}").alias(prefix + c) for c in found.schema["mix"].dataType.names])


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("benchmark_decontamination", benchmarks), ("source_mix", mix)]

#: The quality stage rests on a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written on its way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
