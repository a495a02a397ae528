"""Scan counters and derived measures (AG-1..AG-8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_counters(pages: DataFrame) -> DataFrame:
    """AG-1: completed = page rows; successful = status success; failed =
    neither success nor no_jsonld.  Partial aggregation happens map-side, so a
    scan holding most pages still shuffles one row per task."""
    return pages.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(~F.col("status").isin("success", "no_jsonld")).alias("failed"),
        F.count_if(F.col("status") == "no_jsonld").alias("no_jsonld"),
        F.sum("block_count").alias("blocks"))


def scan_status(control: DataFrame) -> DataFrame:
    """AG-3 / STR-3 (batch form): final status per scan as an order-tolerant fold.

    The last cancel/error event wins (a late error overwrites ``canceled``, a
    cancel after the end overwrites anything); otherwise ``completed`` if a
    completion event exists, ``crawling`` once the URL list exists,
    ``discovering`` once started, else ``queued``.
    """
    term = F.col("type").isin("cancel", "error")
    agg = control.groupBy("scan_id").agg(
        F.max_by(F.when(term, F.col("type")), F.when(term, F.col("seq"))).alias("last_term"),
        F.max_by(F.when(term, F.col("message")), F.when(term, F.col("seq"))).alias("last_msg"),
        F.bool_or(F.col("type") == "completed").alias("has_completed"),
        F.bool_or(F.col("type") == "urls_listed").alias("has_urls"),
        F.bool_or(F.col("type") == "started").alias("has_started"),
        F.max("seq").alias("last_seq"))
    status = (F.when(F.col("last_term") == "cancel", "canceled").when(F.col("last_term") == "error", "failed")
              .when(F.col("has_completed"), "completed").when(F.col("has_urls"), "crawling")
              .when(F.col("has_started"), "discovering").otherwise("queued"))
    return agg.select("scan_id", status.alias("status"),
                      F.when(F.col("last_term") == "error", F.col("last_msg")).alias("error"), "last_seq")
