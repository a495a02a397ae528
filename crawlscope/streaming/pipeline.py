"""Structured Streaming forms of the scan (STR-1..STR-8, AG-3).

* ``stream_pages`` (STR-1, STR-8): page requests arrive as files; each
  micro-batch is processed by the batch page pipeline inside ``foreachBatch``
  and its pages, blocks and entities are persisted as one run of the store,
  named after the query's checkpoint and the batch, so a replayed batch
  rewrites its own run, or does nothing if that was committed.  Requests
  claimed after their scan's cancel event are dropped by a stream-static
  anti join; claims made before the cancel still complete and count.
* ``stream_progress`` (STR-2, STR-7): running per-scan counters as a
  streaming aggregation over the persisted pages (update mode).
* ``stream_lifecycle`` (STR-3..STR-6, AG-3): the order-tolerant status fold
  over control and page events as a streaming aggregation; the sink holds
  the latest state per scan, which is also the reconnect snapshot (STR-6).
* ``stream_events`` (STR-4, STR-5): the typed event stream, of all scans or one.

State sinks are runs of the store too: the changed scans of a batch replace
their rows in hash buckets, published at once.  All checkpoints and sinks live
under the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.operators import extract as X
from crawlscope.operators import store as ST
from crawlscope.session import checkpoint_dir, materialize


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def claimable(requests: DataFrame, control: DataFrame) -> DataFrame:
    """STR-8: drop requests claimed after the scan's first cancel event
    (requests and events share one sequence)."""
    cancels = control.filter(F.col("type") == "cancel").groupBy("scan_id").agg(F.min("seq").alias("cancel_seq"))
    joined = requests.join(cancels, "scan_id", "left")  # stream-static: cancels are a table
    return joined.filter(F.col("cancel_seq").isNull() | (F.col("seq") <= F.col("cancel_seq"))).drop("cancel_seq")


def run_name(checkpoint: str, batch_id: int) -> str:
    """The store's run of a micro-batch: the same for a replay."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch_id}"


def stream_pages(spark: SparkSession, request_dir: str, request_schema, responses: DataFrame, scans: DataFrame,
                 dns: DataFrame | None, control: DataFrame, root: str, checkpoint: str, files_per_trigger: int = 16,
                 persist: Callable = ST.persist_pages) -> str:
    """STR-1: process page requests incrementally into the store ``root``,
    which is returned.  Started again with the same ``checkpoint``, the stream
    goes on with the first batch that was not finished."""
    stream = (spark.readStream.schema(request_schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(request_dir))
    stream = claimable(stream, control)

    # Captures and addresses are static: classify and tokenise them once, not per batch.
    summaries = materialize(X.summarize_responses(responses, scans))
    versions = materialize(X.capture_versions(summaries))
    verdicts = materialize(X.dns_verdicts(dns)) if dns is not None else None

    def process(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        resolved = X.resolve_requests(batch, summaries, scans, verdicts=verdicts, versions=versions)
        pages = materialize(ST.latest_snapshots(X.pages_from_resolved(resolved)).withColumn("created_seq", F.col("seq")))
        owner = pages.select("page_id", "scan_id")
        blocks = materialize(X.blocks_from_pages(pages))
        entities = X.entities_from_blocks(blocks)
        persist(spark, root, pages.drop("scripts"), blocks.join(owner, "page_id"), materialize(entities.join(owner, "page_id")), run_name(checkpoint, batch_id))

    q = (stream.writeStream.foreachBatch(process)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return root


def state_sink(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str) -> str:
    """Update-mode rows by scan: each batch's scans replace their rows."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            ST.write_scan_tables(spark, root, {"state": batch}, run_name(checkpoint, batch_id))

    q = (stream.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return root


# Control event -> published event type (fixed mapping).
EVENT_OF_CONTROL = {"started": "scan_state", "urls_listed": "progress", "completed": "scan_completed",
                    "cancel": "scan_state", "error": "scan_error", "page_completed": "page_completed"}


def typed_events(control: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """STR-4: the published event stream: scan_state / progress /
    page_completed / scan_completed / scan_error (with message), in ``seq``
    order per scan.  Works on streaming or static inputs."""
    m = F.create_map(*[x for k, v in EVENT_OF_CONTROL.items() for x in (F.lit(k), F.lit(v))])
    ev = control.select("scan_id", F.element_at(m, F.col("type")).alias("event"), "seq",
                        F.when(F.col("type") == "error", F.col("message")).alias("message"))
    if pages is not None:
        ev = ev.unionByName(pages.select("scan_id", F.lit("page_completed").alias("event"), "seq",
                                         F.lit(None).cast("string").alias("message")))
    return ev


def page_events(pages: DataFrame) -> DataFrame:
    """STR-4: one ``page_completed`` event per processed page."""
    return pages.select("scan_id", F.lit("page_completed").alias("type"), F.col("seq"),
                        F.lit(None).cast("string").alias("message"), "status")


def fold_events(events: DataFrame) -> DataFrame:
    """STR-3 / STR-7 / AG-3: fold control + page events per scan.

    Counters count every page completion (also after a cancel); status is the
    last cancel/error if any, else completed / crawling / discovering / queued.
    """
    term = F.col("type").isin("cancel", "error")
    agg = events.groupBy("scan_id").agg(
        F.max_by(F.when(term, F.col("type")), F.when(term, F.col("seq"))).alias("last_term"),
        F.max_by(F.when(term, F.col("message")), F.when(term, F.col("seq"))).alias("last_msg"),
        F.max(F.when(F.col("type") == "completed", 1)).alias("has_completed"),
        F.max(F.when(F.col("type") == "urls_listed", 1)).alias("has_urls"),
        F.max(F.when(F.col("type") == "started", 1)).alias("has_started"),
        F.count(F.when(F.col("type") == "page_completed", 1)).alias("completed"),
        F.count(F.when(F.col("status") == "success", 1)).alias("successful"),
        F.count(F.when((F.col("type") == "page_completed") & ~F.col("status").isin("success", "no_jsonld"), 1))
        .alias("failed"),
        F.max("seq").alias("last_seq"))
    status = (F.when(F.col("last_term") == "cancel", "canceled").when(F.col("last_term") == "error", "failed")
              .when(F.col("has_completed").isNotNull(), "completed").when(F.col("has_urls").isNotNull(), "crawling")
              .when(F.col("has_started").isNotNull(), "discovering").otherwise("queued"))
    return agg.select("scan_id", status.alias("status"),
                      F.when(F.col("last_term") == "error", F.col("last_msg")).alias("error"),
                      "completed", "successful", "failed", "last_seq")


def stream_lifecycle(spark: SparkSession, events_dir: str, events_schema, sink: str,
                     scan_id: str | None = None, files_per_trigger: int = 16) -> str:
    """STR-3..STR-6: streaming fold in update mode; every micro-batch
    replaces the changed scans' rows of the store's ``state`` table, which
    is the snapshot a reconnecting subscriber reads first.  ``scan_id``
    narrows the stream to one scan (STR-5)."""
    ev = spark.readStream.schema(events_schema).option("maxFilesPerTrigger", files_per_trigger).parquet(events_dir)
    if scan_id is not None:
        ev = ev.filter(F.col("scan_id") == scan_id)
    folded = fold_events(ev)
    return state_sink(spark, folded, sink, scratch(spark, "ckpt-life"))


def stream_progress(spark: SparkSession, pages_dir: str, pages_schema, sink: str, files_per_trigger: int = 16) -> str:
    """STR-2: running counters per scan over the page sink, update mode."""
    pages = spark.readStream.schema(pages_schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pages_dir)
    counters = pages.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("completed"),
        F.count(F.when(F.col("status") == "success", 1)).alias("successful"),
        F.count(F.when(~F.col("status").isin("success", "no_jsonld"), 1)).alias("failed"))
    return state_sink(spark, counters, sink, scratch(spark, "ckpt-progress"))


def stream_events(spark: SparkSession, events_dir: str, events_schema, sink: str, scan_id: str | None = None, files_per_trigger: int = 16) -> str:
    """STR-4, STR-5: appends the typed events of arriving control and page
    events (of ``scan_id`` only, if given) to ``sink``."""
    ev = spark.readStream.schema(events_schema).option("maxFilesPerTrigger", files_per_trigger).parquet(events_dir)
    if scan_id is not None:
        ev = ev.filter(F.col("scan_id") == scan_id)
    q = (typed_events(ev).writeStream.format("parquet").option("checkpointLocation", scratch(spark, "ckpt-events"))
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return sink


def subscribe(state: DataFrame, scan_id: str) -> DataFrame:
    """STR-5 / STR-6: a subscriber's first event is the current snapshot."""
    return state.filter(F.col("scan_id") == scan_id).select(
        "scan_id", F.lit("scan_state").alias("type"), "status", "completed", "successful", "failed")
