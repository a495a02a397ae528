"""Readers for captured crawl data (SRC-1, SRC-2).

Captured responses are read with an explicit schema (no inference); text
documents (robots.txt, sitemaps) are read whole per file with their path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FetchResult flattened: one row per request outcome.
RESPONSE_SCHEMA = T.StructType([
    T.StructField("scan_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("http_status", T.IntegerType()), T.StructField("content_type", T.StringType()),
    T.StructField("content_length", T.StringType()), T.StructField("location", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("duration_ms", T.IntegerType()), T.StructField("seq", T.LongType()),
])


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-1: captured responses (parquet or JSON lines) with the fixed schema."""
    reader = spark.read.schema(RESPONSE_SCHEMA)
    return reader.parquet(path) if fmt == "parquet" else reader.json(path)


def read_documents(spark: SparkSession, path: str, scan_id_from_path: str = "scan_id=([^/]+)/") -> DataFrame:
    """SRC-2: one row per text document file: scan_id (from the path), url
    (the file path) and the whole body."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"))
    return df.select(F.regexp_extract("url", scan_id_from_path, 1).alias("scan_id"), "url", "body")
