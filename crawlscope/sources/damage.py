"""Damaged exports for the audit: rules that change, repeat or drop rows of the
artifacts of every scan, one of sixteen kinds per scan (kind 0: none).  The
rules only damage; finding it out is the audit's work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCH_MS = 1_767_225_600_000
FENCE = "`" * 30


def with_kind(scans: DataFrame) -> DataFrame:
    """Adds ``kind``, 0 to 15, by the scan's time of creation."""
    return scans.withColumn("kind", (((F.col("created_ms") - EPOCH_MS) / 1000).cast("long") % 16).cast("int"))


def damaged_rows(rows: DataFrame, scans: DataFrame) -> DataFrame:
    """``artifact.export_rows`` with every scan's kind of damage done."""
    ends = rows.filter("rank = 1").groupBy("scan_id").agg(F.min("url").alias("first_url"), F.max("url").alias("last_url"))
    r = rows.join(with_kind(scans).select("scan_id", "kind"), "scan_id").join(ends, "scan_id", "left")
    first, last = F.col("url") == F.col("first_url"), F.col("url") == F.col("last_url")
    text = F.col("text")
    final = r.filter("rank = 1 AND format = 'csv'").groupBy("scan_id").agg(
        F.max(F.struct("url", "ordinal", "path")).alias("end"))
    r = r.join(final, "scan_id", "left")
    at_end = F.struct("url", "ordinal", "path").eqNullSafe(F.col("end"))

    def case(kind, fmt, rank):
        return (F.col("kind") == kind) & (F.col("format") == fmt) & (F.col("rank") == rank)
    body = F.regexp_replace(text, ",?\\n\\z", "")
    changed = (
        F.when(case(1, "json", 0), F.replace(text, F.lit('"formatVersion": 1'), F.lit('"formatVersion": 2')))
        .when(case(2, "json", 1) & first, F.concat(body, F.lit(",\n"), text))
        .when(case(3, "json", 1), F.replace(text, F.lit('"scanId": "'), F.lit('"scanId": "x')))
        .when(case(4, "json", 1) & last, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")))
        .when(case(6, "csv", 0), F.replace(text, F.lit("parse_status"), F.lit("status")))
        .when(case(7, "csv", 1) & at_end, F.concat(text, F.lit('"open\n')))
        .when(case(8, "csv", 1), F.replace(text, F.lit(",valid,"), F.lit(",maybe,")))
        .when(case(10, "markdown", 1) & first, F.concat(text, F.lit(FENCE + "\n")))
        .when(case(11, "markdown", 1), F.replace(text, F.lit("\nValid JSON-LD\n"), F.lit("\nParse error: x\n")))
        .when(case(12, "json", 0), F.regexp_replace(text, '("completed": [0-9]+)', "$10"))
        .when(case(13, "json", 1), F.replace(text, F.lit('"pageId": "'), F.lit('"pageId": "x')))
        .when(case(14, "json", 1), F.replace(text, F.lit('"blockId": "'), F.lit('"blockId": "x')))
        .when(case(15, "csv", 1), F.regexp_replace(text, "\n\\z", ",extra\n")))
    dropped = case(4, "json", 2) | ((case(5, "csv", 1) | case(9, "markdown", 1)) & first)
    return r.withColumn("text", F.coalesce(changed, text)).filter(~F.coalesce(dropped, F.lit(False))).select(*rows.columns)
