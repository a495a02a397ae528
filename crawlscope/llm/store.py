"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import gc
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.session import checkpoint_dir, ship_with_tasks

ship_with_tasks(sys.modules[__name__])

MEMBER_BITS = 1 << 27  # 16 MB, whatever the data
_PAGE = 32768          # bits of one bitmap_construct_agg result
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Session settings of the text operators: small Arrow batches, so that a
    batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


_settled = {}  # Spark application -> bytes of the driver's heap after its garbage was last collected


def release(spark: SparkSession) -> None:
    """Give back what the driver holds but no longer needs.

    The tables that Spark broadcasts for small joins, and the plans of finished
    jobs, stay in the driver until its garbage is collected, and a heap that
    grows while many short jobs are planned does not shrink by itself.  So where
    it takes over a third of its limit, and an eighth more than when last
    collected, it is collected; the result of a job never depends on it."""
    pa.default_memory_pool().release_unused()
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    app = spark.sparkContext.applicationId
    if runtime.totalMemory() > max(runtime.maxMemory() / 3, 1.125 * _settled.get(app, 0)):
        gc.collect()  # the JVM keeps what Python still refers to
        runtime.gc()
        _settled[app] = runtime.totalMemory()


def save(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet under ``spark.checkpoint.dir`` and read it
    back: cuts lineage, survives lost executors, takes less room than an RDD
    checkpoint.  The files belong to that folder's own cleaning policy; the
    shuffle files of the write are removed as soon as it is done."""
    spark = df.sparkSession
    release(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by ``save`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def membership(ids: DataFrame):
    """Broadcast bitmap of the ids (one long column) modulo MEMBER_BITS.

    It lets a scan drop rows that a join on these ids would drop anyway, before
    they are shuffled.  Its size is fixed: with very many ids it fills up and
    drops less, and the join, which always follows, does all the work."""
    h = F.pmod(F.col(ids.columns[0]), F.lit(MEMBER_BITS))
    pages = (ids.select((h / _PAGE).cast("long").alias("page"), (h % _PAGE).alias("place"))
             .groupBy("page").agg(F.bitmap_construct_agg("place").alias("bits")).toArrow())
    bits = np.zeros(MEMBER_BITS // 8, dtype=np.uint8)
    for page, raw in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist()):
        bits[page * _PAGE // 8:(page + 1) * _PAGE // 8] = np.frombuffer(raw, dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bits)


def may_belong(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the bitmap admits: all members, and a few others."""
    h = ids.view(np.uint64) & np.uint64(MEMBER_BITS - 1)
    return (bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def only_members(rows: DataFrame, column: str, ids: DataFrame, shared=None) -> DataFrame:
    """``rows`` less most of those whose ``column`` (long, never null) is not
    among ``ids``; ``shared``: their ``membership``, if the caller destroys it."""
    shared = shared or membership(ids)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_belong(shared.value, batch.column(column).to_numpy()), pa.bool_()))
    return rows.mapInArrow(run, rows.schema)
