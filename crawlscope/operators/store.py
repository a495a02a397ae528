"""Stored scan tables and their queries (ST-1..ST-16, SNK-4..SNK-7).

Tables: scans, pages, jsonld_blocks, schema_entities.  Each write is a run of
its own: its files lie under the run's id and become visible, for all its
tables at once, with the commit that is created last.  A reader takes for each
scan and table the latest committed run, so a rewrite with fewer children
leaves none behind and a half-written run is never seen.

Commits are numbered files whose creation fails if the number is taken, so two
writers never share one; a writer that merged with stored rows and finds that
another has since committed the same scans merges again.  A run that is written
again under its own id (a replayed batch) replaces its files, and does nothing
once it is committed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscope.session import materialize

TABLES = ("scans", "pages", "jsonld_blocks", "schema_entities")
TERMINAL = ("completed", "canceled", "failed")


class NotFound(LookupError):
    pass


def upsert_pages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """ST-4: upsert on (scan_id, normalized_url).

    Keeps the first ``page_id`` and ``created_seq`` (a stored one before any
    incoming one); the last write (highest ``seq``; of equal ones the incoming)
    wins for the other columns.  A hash aggregate on the natural key with
    partial aggregation before the shuffle.
    """
    cols = [c for c in incoming.columns if c not in ("page_id", "scan_id", "normalized_url", "seq", "created_seq")]
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first, last = F.struct("_new", "seq", "page_id"), F.struct("seq", "_new", "page_id")
    out = both.groupBy("scan_id", "normalized_url").agg(
        F.min_by("page_id", first).alias("page_id"), F.min_by("created_seq", first).alias("created_seq"), F.max("seq").alias("seq"),
        F.max_by(F.struct(*cols), last).alias("_last"))
    return out.select("page_id", "scan_id", "normalized_url", "seq", "created_seq", "_last.*")


def ownership_rejects(pages: DataFrame, blocks: DataFrame, entities: DataFrame, key: list[str] | None = None) -> DataFrame:
    """ST-6: page ids whose snapshot is inconsistent (block of a foreign page,
    duplicate block id, entity of a block outside the snapshot).  ``key`` names
    what tells snapshots apart."""
    key = key or ["page_id"]
    foreign_block = blocks.join(pages.select(*key), key, "left_anti").select("page_id")
    dup_block = blocks.groupBy(*key, "block_id").count().filter("count > 1").select("page_id")
    own = blocks.select("block_id", *key).distinct()
    orphan_entity = entities.join(own, ["block_id", *key], "left_anti").select("page_id")
    return foreign_block.unionByName(dup_block).unionByName(orphan_entity).distinct()


def replace_children(old_blocks: DataFrame, old_entities: DataFrame, new_pages: DataFrame,
                     new_blocks: DataFrame, new_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST-5: children of re-written pages are replaced, others kept.

    ``new_pages`` carries the surviving ``page_id`` (after ST-4); the new
    blocks and entities must already reference that id.
    """
    touched = new_pages.select("page_id")
    kept_blocks = old_blocks.join(touched, "page_id", "left_anti")
    kept_entities = old_entities.join(kept_blocks.select("block_id"), "block_id", "left_semi")
    return kept_blocks.unionByName(new_blocks), kept_entities.unionByName(new_entities)


def cascade_delete(scans: DataFrame, pages: DataFrame, blocks: DataFrame, entities: DataFrame,
                   keep_scans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """ST-16: keep only rows reachable from ``keep_scans`` (scan_id)."""
    s = scans.join(keep_scans, "scan_id", "left_semi")
    p = pages.join(s.select("scan_id"), "scan_id", "left_semi")
    b = blocks.join(p.select("page_id"), "page_id", "left_semi")
    e = entities.join(b.select("block_id"), "block_id", "left_semi")
    return s, p, b, e


def keep_latest_only(scans: DataFrame) -> DataFrame:
    """SNK-4: the reference keeps a single active scan; selecting the latest
    per ``created_ms`` reproduces that view over a multi-scan table."""
    return latest_scan(scans).select("scan_id")


def latest_scan(scans: DataFrame) -> DataFrame:
    """ST-2: ORDER BY created DESC LIMIT 1 (TakeOrderedAndProject)."""
    return scans.orderBy(F.col("created_ms").desc(), F.col("scan_id").desc()).limit(1)


def get_scan(scans: DataFrame, scan_id: str) -> DataFrame:
    """ST-1: one scan; raises ``NotFound`` with the reference's message."""
    row = scans.filter(F.col("scan_id") == scan_id).limit(1)
    if row.isEmpty():
        raise NotFound(f"Scan not found: {scan_id}")
    return row


def get_page(pages: DataFrame, scan_id: str, page_id: str) -> DataFrame:
    """ST-7: one page of a scan; raises ``NotFound``."""
    row = pages.filter((F.col("scan_id") == scan_id) & (F.col("page_id") == page_id)).limit(1)
    if row.isEmpty():
        raise NotFound(f"Page not found: {page_id}")
    return row


def list_pages(pages: DataFrame, scan_id: str | None = None, status: str | None = None) -> DataFrame:
    """ST-3: pages of a scan, optional status filter, ordered by url."""
    p = pages if scan_id is None else pages.filter(F.col("scan_id") == scan_id)
    if status is not None:
        p = p.filter(F.col("status") == status)
    return p.orderBy("scan_id", "url")


def page_blocks(blocks: DataFrame, page_id: str) -> DataFrame:
    """ST-8: blocks of a page by ordinal."""
    return blocks.filter(F.col("page_id") == page_id).orderBy("ordinal")


def page_entities(entities: DataFrame, blocks: DataFrame, page_id: str) -> DataFrame:
    """ST-9: entities of a page: entity join block, by ordinal then entity order."""
    b = blocks.filter(F.col("page_id") == page_id).select("block_id", "ordinal")
    return entities.join(b, "block_id").orderBy("ordinal", "entity_path")


def scan_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """ST-10: all blocks of each scan (block join page)."""
    return blocks.join(pages.select("page_id", "scan_id"), "page_id")


def scan_entities(entities: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """ST-11: all entities of each scan (entity join block join page)."""
    return (entities.join(blocks.select("block_id", "ordinal", F.col("page_id").alias("_bp")), "block_id")
            .join(pages.select(F.col("page_id").alias("_bp"), "scan_id"), "_bp").drop("_bp"))


_BLOCK_STRUCT = ["ordinal", "block_id", "raw_text", "parsed_json", "parse_error"]
_ENTITY_STRUCT = ["ordinal", "entity_path", "entity_id", "block_id", "context", "types", "serialized"]


def site_documents(pages: DataFrame, blocks: DataFrame, entities: DataFrame, block_columns: list[str] | None = None) -> DataFrame:
    """ST-12 / ST-13: one nested document row per page.

    Blocks and entities are grouped per page (hash aggregate keyed by the
    page id: one page's children are bounded by its HTML) and left-joined, so
    pages without children get empty lists.  JSON stays text inside the
    structs (VARIANT is not orderable).
    """
    b = blocks.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct(*(block_columns or _BLOCK_STRUCT)))).alias("blocks"))
    e = (entities.join(blocks.select("block_id", "ordinal"), "block_id")
         .groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*_ENTITY_STRUCT))).alias("entities")))
    doc = pages.join(b, "page_id", "left").join(e, "page_id", "left")
    return (doc.withColumn("blocks", F.coalesce("blocks", F.array().cast(b.schema["blocks"].dataType)))
            .withColumn("entities", F.coalesce("entities", F.array().cast(e.schema["entities"].dataType))))


BUCKETS = 64  # folders of a run and table: scans by hash
_COMMIT = "seq long, mark string, base boolean, schemas map<string,string>"
_MARKS = "scan_id string, name string, run string, mark string"


class Conflict(RuntimeError):
    """Another run committed the same scans in the meantime."""


def _bucket(scan_id) -> F.Column:
    return F.pmod(F.xxhash64(scan_id), F.lit(BUCKETS)).cast("int")


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _stored(spark: SparkSession, path: str) -> bool:
    folder, fs = _path(spark, path)
    return fs.exists(folder)


def commits(spark: SparkSession, root: str) -> list:
    """Commits in order, from the last that stands for all before it."""
    if not _stored(spark, f"{root}/_commit"):
        return []
    found = sorted(spark.read.schema(_COMMIT).json(f"{root}/_commit").collect(), key=lambda r: r.seq)
    base = max((k for k, r in enumerate(found) if r.base), default=0)
    return found[base:]


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file unless it exists; whether it did."""
    from py4j.protocol import Py4JJavaError

    file, fs = _path(spark, path)
    try:
        out = fs.create(file, False)
    except Py4JJavaError as e:
        if "Exist" in e.java_exception.getClass().getName() or fs.exists(file):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _marks(spark: SparkSession, root: str, found: list) -> DataFrame:
    """(scan_id, name, run, seq) of the commits ``found``."""
    order = spark.createDataFrame([(c.mark, c.seq) for c in found], "mark string, seq long")
    return spark.read.schema(_MARKS).parquet(f"{root}/_marks").join(F.broadcast(order), "mark")  # compact() bounds the commits


def _publish(spark: SparkSession, root: str, run: str, schemas: dict[str, str], merged_with: int | None) -> None:
    while True:
        found = commits(spark, root)
        if any(c.mark == run for c in found):
            return
        last = found[-1].seq if found else 0
        newer = [c for c in found if merged_with is not None and c.seq > merged_with]
        if newer:
            mine = spark.read.schema(_MARKS).parquet(f"{root}/_marks").filter(F.col("mark") == run)
            if not _marks(spark, root, newer).join(mine, ["scan_id", "name"], "left_semi").isEmpty():
                raise Conflict(run)
        line = json.dumps({"seq": last + 1, "mark": run, "base": False, "schemas": schemas})
        if _create(spark, f"{root}/_commit/{last + 1:012d}.json", line):
            return


def write_scan_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], run: str | None = None, merged_with: int | None = None) -> str:
    """SNK-4 / SNK-5 / SNK-6: write ``tables`` (by name, each with scan_id) as
    one run that replaces the scans of its ``scans`` or ``pages`` table (else of
    its first); a table that is not given keeps its rows.  Rows are dealt to a fixed number of
    folders and rebalanced, so a large scan is written by many tasks and many
    small ones share files.  Returns the run's id."""
    run = run or f"r{uuid.uuid4().hex}"
    if any(c.mark == run for c in commits(spark, root)):
        return run
    for name, df in tables.items():
        rows = df.withColumn("bucket", _bucket("scan_id"))
        (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "scan_id")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}/run={run}"))
    scans = tables[next((n for n in ("scans", "pages") if n in tables), next(iter(tables)))]
    names = F.explode(F.array(*[F.lit(n) for n in tables])).alias("name")
    marks = scans.select("scan_id").distinct().select("scan_id", names, F.lit(run).alias("run"))
    marks.write.mode("overwrite").parquet(f"{root}/_marks/mark={run}")
    _publish(spark, root, run, {n: df.schema.json() for n, df in tables.items()}, merged_with)
    return run


def read_scan_tables(spark: SparkSession, root: str, scan_id: str | None = None) -> dict[str, DataFrame]:
    """SRC-3: the stored tables with the schemas they were written with, each
    scan by its latest committed run; a table without rows is empty.  With
    ``scan_id`` only the folder of that scan's bucket and run is opened."""
    found = commits(spark, root)
    if not found:
        return {}
    marks = _marks(spark, root, found)
    if scan_id is not None:
        marks = marks.filter(F.col("scan_id") == scan_id)
    latest = marks.groupBy("scan_id", "name").agg(F.max_by("run", "seq").alias("run"))
    schemas = {n: T.StructType.fromJson(json.loads(text)) for c in found for n, text in c.schemas.items()}
    one = {r.name: r.run for r in latest.collect()} if scan_id is not None else {}
    out = {}
    for name, schema in schemas.items():
        if not _stored(spark, f"{root}/{name}"):
            out[name] = spark.createDataFrame([], schema)
            continue
        with_place = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
        reader = spark.read.schema(with_place).option("basePath", f"{root}/{name}")
        if scan_id is not None:
            folder = f"{root}/{name}/run={one.get(name)}"
            if not _stored(spark, folder):
                out[name] = spark.createDataFrame([], schema)
                continue
            rows = reader.parquet(folder).filter((F.col("bucket") == _bucket(F.lit(scan_id))) & (F.col("scan_id") == scan_id))
        else:
            rows = reader.parquet(f"{root}/{name}").join(latest.filter(F.col("name") == name).select("scan_id", "run"), ["scan_id", "run"], "left_semi")
        out[name] = rows.drop("run", "bucket").select(*schema.names)
    return out


def compact(spark: SparkSession, root: str) -> list[str]:
    """Writes the present state as one commit and removes the commits before it
    and the runs that no scan needs any more.  Returns the runs removed.  For
    a time without writers and readers of older states."""
    found = commits(spark, root)
    if not found:
        return []
    latest = materialize(_marks(spark, root, found).groupBy("scan_id", "name").agg(F.max_by("run", "seq").alias("run")))
    mark = f"base{uuid.uuid4().hex}"
    latest.repartitionByRange("scan_id", "name").sortWithinPartitions("scan_id", "name").write.parquet(f"{root}/_marks/mark={mark}")
    schemas = {n: text for c in found for n, text in c.schemas.items()}
    seq = found[-1].seq + 1
    line = json.dumps({"seq": seq, "mark": mark, "base": True, "schemas": schemas})
    if not _create(spark, f"{root}/_commit/{seq:012d}.json", line):
        raise Conflict(mark)
    live = {(r.name, r.run) for r in latest.select("name", "run").distinct().collect()}  # runs, not scans
    gone = set()
    for name in schemas:
        folder, fs = _path(spark, f"{root}/{name}")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            run = status.getPath().getName().removeprefix("run=")
            if (name, run) not in live:
                fs.delete(status.getPath(), True)
                gone.add(run)
    for c in found:
        for path in (f"{root}/_commit/{c.seq:012d}.json", f"{root}/_marks/mark={c.mark}"):
            file, fs = _path(spark, path)
            fs.delete(file, True)
    return sorted(gone - {run for _, run in live})


def latest_snapshots(pages: DataFrame) -> DataFrame:
    """Of several snapshots of a page in one batch the last (highest ``seq``)."""
    rest = [c for c in pages.columns if c not in ("scan_id", "normalized_url", "seq")]
    last = pages.groupBy("scan_id", "normalized_url").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*rest), F.struct("seq", "page_id")).alias("_last"))
    return last.select("scan_id", "normalized_url", "seq", "_last.*").select(*pages.columns)


def _merge(old: dict[str, DataFrame], pages: DataFrame, blocks: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """ST-4, ST-5: stored rows of the scans concerned with new snapshots."""
    key = ["scan_id", "normalized_url"]
    stored = old.get("pages")
    merged = materialize(upsert_pages(stored if stored is not None else pages.limit(0), pages))
    # The snapshot that holds, under the id it came with, and the id that stays.
    came = pages.select(*key, "seq", F.col("page_id").alias("came_id"), F.lit(True).alias("new"))
    if stored is not None:
        came = came.unionByName(stored.select(*key, "seq", F.col("page_id").alias("came_id"), F.lit(False).alias("new")))
    holds = came.groupBy(*key).agg(F.max(F.struct("seq", "new", "came_id")).alias("h")).select(*key, "h.*")
    holds = materialize(holds.join(merged.select(*key, "page_id"), key))
    mine = holds.filter("new").select("came_id", F.col("page_id").alias("kept_id"), F.col("seq").alias("came_seq"))
    kept = holds.filter("NOT new").select("page_id")

    def under_kept(children: DataFrame) -> DataFrame:
        cond = F.col("page_id") == F.col("came_id")
        if "seq" in children.columns:  # snapshots that share an id are told apart by their number
            cond = cond & (F.col("seq") == F.col("came_seq"))
        names = [c for c in children.columns if c != "seq"]
        return children.join(mine, cond).select(*[F.col("kept_id").alias(c) if c == "page_id" else c for c in names])
    new_blocks = under_kept(blocks)
    out = {"pages": merged, "jsonld_blocks": new_blocks, "schema_entities": under_kept(entities)}
    if stored is not None:
        old_blocks = old["jsonld_blocks"].join(kept, "page_id", "left_semi")
        old_entities = old["schema_entities"].join(old_blocks.select("block_id"), "block_id", "left_semi")
        out["jsonld_blocks"] = old_blocks.unionByName(new_blocks)
        out["schema_entities"] = old_entities.unionByName(out["schema_entities"])
    return out


def persist_pages(spark: SparkSession, root: str, pages: DataFrame, blocks: DataFrame, entities: DataFrame, run: str | None = None) -> str:
    """ST-4..ST-6, SNK-4: store page snapshots (pages with seq and created_seq;
    children with scan_id, and with seq where snapshots share a page_id) as one
    run.

    Snapshots with foreign or repeated children are refused as a whole; pages
    are merged on their natural key, of several snapshots of a page only the
    last keeps its children, the children of rewritten pages are replaced, all
    others kept, and the scans concerned are published together.  ``run`` names
    a batch that may be replayed."""
    key = ["page_id", "seq"] if "seq" in blocks.columns else ["page_id"]
    refused = [r.page_id for r in ownership_rejects(pages, blocks, entities, key).limit(5).collect()]
    if refused:
        raise ValueError(f"blocks or entities do not belong to their page: {', '.join(refused)}")
    for _ in range(8):
        found = commits(spark, root)
        if run is not None and any(c.mark == run for c in found):
            return run
        scans = pages.select("scan_id").distinct()
        old = {k: v.join(scans, "scan_id", "left_semi") for k, v in read_scan_tables(spark, root).items() if k != "scans"}
        merged = _merge(old, pages, blocks, entities)
        try:
            return write_scan_tables(spark, root, merged, run, found[-1].seq if found else 0)
        except Conflict:
            continue
    raise Conflict(f"the scans of {run or 'the batch'} are written by others all the time")
