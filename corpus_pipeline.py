"""Corpus pipeline: five of the training-data operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them to ``documents``, writing every stage's result as Parquet in the shared
checkpoint folder before the next one reads it.  All stages but the last return
the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.llm import decontaminate, jaccard, lines, packing, quality
from crawlscope.llm.labelled import fold
from crawlscope.llm.store import save
from crawlscope.sources.tables import load


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents scored below the threshold go."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    return quality.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near copies the first line stays; documents
    that lose every visible character with their lines go.  n_chars follows."""
    left = lines.deduplicate(docs).withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return left.where(F.col("removed").isNull() | F.col("text").rlike(r"\S")).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on five-word shingles at a similarity of 0.8: the smallest
    doc_id of each group stays."""
    return jaccard.keep_first(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a window of the benchmark go."""
    return decontaminate.remove(docs, load(spark, sf_dir, "benchmark"), whole=True)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of the remaining documents and their places."""
    return packing.pack(packing.pieces(docs, packing.default_vocabulary()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # classifier and packing are not expressible in SQL; tests/llm checks the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
