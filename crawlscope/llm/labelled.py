"""Labelled training rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHARES = 1_000_000


def fold(doc_id: str, modulus: int):
    """crc32 of the decimal doc_id, modulo ``modulus`` (null: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(0).cast("long"))


def bounded_sample(labels: DataFrame, column: str, allowed, limit: int) -> dict[int, int]:
    """doc_id -> 0/1 for the rows of ``labels`` that ``allowed`` admits, thinned
    by a hash of doc_id to about ``limit`` rows where there are more (a quarter
    more at most).  Null ids and labels are left out; of repeated rows the
    larger label holds."""
    rows = (labels.where(allowed & F.col("doc_id").isNotNull() & F.col(column).isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y")))
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES)) < int(_SHARES * limit / n))
    return {r.doc_id: int(r.y > 0) for r in rows.limit(limit + limit // 4).collect()}
