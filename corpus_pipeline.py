"""From raw documents to token ids: five stages, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on the documents that the stage
before it kept. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeflow.llm import bpe, decontamination, lines, near, quality, work
from storeflow.llm.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learned from ``labels`` puts above its cut."""
    ranking = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), ranking) >= 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier one; a document may end up empty."""
    shorter = lines.without_repeated_lines(docs)
    if "n_chars" not in docs.columns:
        return shorter
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near.without_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    coded = bpe.encode(docs, bpe.vocabulary_file())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", token_stage),
]

# Fitting, similarity links and merges have no form in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = work.written(stage(spark, docs, sf_dir), "stage")
    return docs


def load() -> tuple[dict, dict]:
    return {"pipeline": run}, {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
