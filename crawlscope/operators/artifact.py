"""Exports as whole artifacts (SNK-1..3, SNK-7..9, EX-8).

An artifact is one scan (or one page) in one format.  Its bytes are cut into
rows: a header, the pages in URL order (a CSV row per entity, a Markdown
section or a JSON element per page) and a footer.  ``write_artifacts`` sorts
the rows of all artifacts together by range, so that a scan with most pages is
still written by many tasks; a task streams its rows into one data file and
reports which bytes of it belong to which artifact.  The manifest, one row per
part with its place, bytes and checksum, says how the parts make an artifact:
put end to end they are byte for byte the document a single writer would make.

Data files bear the name of the task attempt that wrote them.  Only what a
committed attempt reported enters the manifest, and the manifest is written
last, so lost executors leave nothing that a reader sees.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscope.operators import exports as EX
from crawlscope.operators.extract import ScanTables
from crawlscope.operators import urlset as U
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

FORMATS = ("json", "csv", "markdown")
HEADER, BODY, FOOTER = 0, 1, 2

# Settings and counters of a scan, as columns and as fields of the JSON export
# (fixed names, in the export's order).
SETTINGS_FIELDS = [("max_urls", "maxUrls"), ("concurrency", "concurrency"), ("delay_ms", "delayMs"), ("timeout_ms", "timeoutMs"),
                   ("max_response_bytes", "maxResponseBytes"), ("max_redirects", "maxRedirects"), ("respect_robots", "respectRobots"),
                   ("same_origin_only", "sameOriginOnly")]
COUNTER_FIELDS = ["discovered", "queued", "completed", "successful", "failed"]
ROWS = "scan_id string, format string, rank int, url string, ordinal int, path string, text string"
PARTS = "scan_id string, format string, rank int, url string, ordinal int, path string, file string, first long, bytes long, crc32 long, rows long"


def iso_time(ms) -> Column:
    """Milliseconds as an ISO time in UTC with milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def quoted(text: Column) -> Column:
    """A JSON string (null: ``null``).  Escapes of control characters have
    small letters in the export, capital ones in ``to_json``."""
    raw = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    raw = F.substring(raw, F.lit(6), F.length(raw) - 6)  # {"v": ... }
    small = raw
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*+)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(text.rlike("[\\x0B\\x0E\\x0F\\x1A-\\x1F]"), small).otherwise(raw)


def _object(fields: list[tuple[str, Column]], indent: int) -> Column:
    """A JSON object over several lines; values are JSON texts."""
    pad = " " * indent
    rows = [F.concat(F.lit(f'{pad}  "{name}": '), F.coalesce(value, F.lit("null"))) for name, value in fields]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *rows), F.lit(f"\n{pad}}}"))


def _array(items: Column, indent: int) -> Column:
    """A JSON array of texts, each item on its own lines; empty: ``[]``."""
    pad = " " * indent
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"{pad}  "), x)), ",\n")
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), lines, F.lit(f"\n{pad}]")))


def _plain(value: Column) -> Column:
    return value.cast("string")


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')


def lay_out(text: str, indent: int) -> str:
    """A compact JSON text over several lines, two blanks per level, that
    starts ``indent`` blanks in."""
    out, open_ = [], []
    tokens = _TOKEN.findall(text)
    for k, token in enumerate(tokens):
        if token in "}]":
            open_.pop()
            out.append(token if tokens[k - 1] in "{[" else "\n" + " " * (indent + 2 * len(open_)) + token)
            continue
        if open_ and tokens[k - 1] in "{[," and tokens[k - 1] != ":":
            out.append("\n" + " " * (indent + 2 * len(open_)))
        out.append(": " if token == ":" else token)
        if token in "{[":
            open_.append(token)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _laid_out_parsed(texts):
    """``parsed`` of a block of the JSON export, ten blanks in."""
    return texts.map(lambda t: None if t is None else lay_out(t, 10))


def json_element(docs: DataFrame) -> Column:
    """SNK-1: a page of the JSON export with its blocks and entities, four
    blanks in.  ``docs``: rows of ``site_documents`` whose blocks carry
    ``laid_out``, the parsed value over several lines."""
    page = _object([
        ("id", quoted(F.col("page_id"))), ("scanId", quoted(F.col("scan_id"))), ("url", quoted(F.col("url"))),
        ("normalizedUrl", quoted(F.col("normalized_url"))), ("sitemapSource", quoted(F.col("sitemap_source"))),
        ("status", quoted(F.col("status"))), ("httpStatus", _plain(F.col("http_status"))), ("contentType", quoted(F.col("content_type"))),
        ("durationMs", _plain(F.col("duration_ms"))), ("error", quoted(F.col("error"))), ("createdAt", quoted(iso_time("created_ms")))], 6)
    blocks = F.transform("blocks", lambda b: _object([
        ("id", quoted(b["block_id"])), ("pageId", quoted(F.col("page_id"))), ("ordinal", _plain(b["ordinal"])),
        ("rawText", quoted(b["raw_text"])), ("parsed", b["laid_out"]), ("parseError", quoted(b["parse_error"]))], 8))
    entities = F.transform("entities", lambda e: _object([
        ("id", quoted(e["entity_id"])), ("blockId", quoted(e["block_id"])), ("context", quoted(e["context"])),
        ("types", _array(F.transform(e["types"], quoted), 10)), ("serialized", quoted(e["serialized"]))], 8))
    return F.concat(F.lit("    "), _object([("page", page), ("blocks", _array(blocks, 6)), ("entities", _array(entities, 6))], 4))


def json_head(scans: DataFrame) -> Column:
    """The JSON export up to the first page: all fields of the scan.  ``scans``
    has n_pages, null for a scan without pages."""
    settings = _object([(name, _plain(F.col(column))) for column, name in SETTINGS_FIELDS], 4)
    scan = _object([("id", quoted(F.col("scan_id"))), ("targetUrl", quoted(F.col("target_url"))), ("sitemapUrl", quoted(F.col("sitemap_url"))),
                    ("settings", settings), ("status", quoted(F.col("status"))), ("createdAt", quoted(iso_time("created_ms"))),
                    ("updatedAt", quoted(iso_time("updated_ms")))]
                   + [(c, _plain(F.coalesce(F.col(c), F.lit(0)))) for c in COUNTER_FIELDS] + [("error", quoted(F.col("error")))], 2)
    return F.concat(F.lit('{\n  "formatVersion": 1,\n  "scan": '), scan, F.lit(',\n  "pages": ['),
                    F.when(F.col("n_pages").isNull(), F.lit("")).otherwise(F.lit("\n")))


def documents(t: ScanTables) -> DataFrame:
    """Pages with their blocks (parsed values laid out) and entities."""
    from crawlscope.operators import store as ST

    laid = t.blocks.withColumn("laid_out", _laid_out_parsed("parsed_json"))
    return ST.site_documents(t.pages, laid, t.entities, block_columns=[*ST._BLOCK_STRUCT, "laid_out"])


def export_rows(scans: DataFrame, t: ScanTables, formats=FORMATS) -> DataFrame:
    """The rows of every artifact: scan_id, format, their place (rank, url,
    ordinal, path) and their text, line ends included: a row starts where a line
    starts.

    scans: scan_id, target_url, sitemap_url, settings, status, created_ms,
    updated_ms, counters, error; only those in a terminal state are exported
    (SNK-8).  Pages with created_ms."""
    gate, _ = EX.export_gate(scans)
    pages = t.pages.join(gate.select("scan_id"), "scan_id", "left_semi")
    counts = pages.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max(F.struct("url", "page_id")).alias("last"))
    heads = gate.join(counts, "scan_id", "left")
    none = F.col("n_pages").isNull()
    parts = []

    def row(df, fmt, rank, text, url=None, ordinal=None, path=None):
        lit = lambda x, kind: F.lit(None).cast(kind) if x is None else F.col(x)
        return df.select("scan_id", F.lit(fmt).alias("format"), F.lit(rank).alias("rank"), lit(url, "string").alias("url"),
                         lit(ordinal, "int").alias("ordinal"), lit(path, "string").alias("path"), text.alias("text"))
    if "json" in formats:
        docs = documents(ScanTables(pages, t.blocks, t.entities)).join(
            counts.select("scan_id", F.col("last.page_id").alias("last_page")), "scan_id")
        tail = F.when(F.col("page_id") == F.col("last_page"), F.lit("\n")).otherwise(F.lit(",\n"))
        parts += [row(heads, "json", HEADER, json_head(heads)),
                  row(docs, "json", BODY, F.concat(json_element(docs), tail), "url", None, "page_id"),
                  row(heads, "json", FOOTER, F.when(none, F.lit("]\n}")).otherwise(F.lit("  ]\n}")))]
    if "csv" in formats:
        lines = EX.csv_rows(pages, t.blocks, t.entities).join(pages.select("page_id", "scan_id"), "page_id")
        parts += [row(heads, "csv", HEADER, F.lit(EX.CSV_HEADER + "\n")),
                  row(lines, "csv", BODY, F.concat("line", F.lit("\n")), "url", "ordinal", "entity_path")]
    if "markdown" in formats:
        header = EX.md_header(gate, pages)
        sections = EX.md_sections(pages, t.blocks)
        parts += [row(header, "markdown", HEADER, F.concat("header", F.lit("\n"))),
                  row(sections, "markdown", BODY, F.concat("section", F.lit("\n")), "url", None, "page_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def artifact_names(scans: DataFrame) -> DataFrame:
    """SNK-9: scan_id, format and file name of each site export."""
    named = U.export_names(scans.select("scan_id", "target_url"), "target_url", None)
    formats = F.explode(F.array(*[F.lit(f) for f in FORMATS])).alias("format")
    return named.select("scan_id", "site_basename", formats).select(
        "scan_id", "format", F.concat("site_basename", F.lit("."), U.export_extension("format")).alias("name"))


def file_system(folder: str):
    """pyarrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", folder))
    return fs.LocalFileSystem(), folder


_PLACE = ["scan_id", "format", "rank", "url", "ordinal", "path"]
_PART_ROWS = pa.schema([("scan_id", pa.string()), ("format", pa.string()), ("rank", pa.int32()), ("url", pa.string()), ("ordinal", pa.int32()),
                        ("path", pa.string()), ("file", pa.string()), ("first", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("rows", pa.int64())])


def write_artifacts(rows: DataFrame, names: DataFrame, folder: str) -> DataFrame:
    """Writes the artifacts of ``rows`` below ``folder`` and returns the
    manifest: scan_id, format, name, part (from 0), file, first, bytes, crc32,
    rows."""
    spark = rows.sparkSession
    fs, root = file_system(folder)
    fs.create_dir(f"{root}/data", recursive=True)

    def write(batches):
        files, path = file_system(folder)
        name, out, at, parts = f"{uuid.uuid4().hex}.bin", None, 0, []
        for batch in batches:
            if out is None:
                out = files.open_output_stream(f"{path}/data/{name}")
            for r in batch.to_pylist():
                data = (r["text"] or "").encode("utf-8", "surrogatepass")
                if not parts or (parts[-1]["scan_id"], parts[-1]["format"]) != (r["scan_id"], r["format"]):
                    parts.append({c: r[c] for c in _PLACE} | {"file": name, "first": at, "bytes": 0, "crc32": 0, "rows": 0})
                out.write(data)
                at += len(data)
                last = parts[-1]
                last["bytes"] += len(data)
                last["rows"] += 1
                last["crc32"] = zlib.crc32(data, last["crc32"])
        if out is not None:
            out.close()
        if parts:
            yield pa.RecordBatch.from_pylist(parts, schema=_PART_ROWS)
    written = rows.select(*_PLACE, "text").repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE).mapInArrow(write, PARTS)
    staged = f"{folder.rstrip('/')}/written-{uuid.uuid4().hex}"
    written.write.parquet(staged)
    place = Window.partitionBy("scan_id", "format").orderBy("rank", "url", "ordinal", "path")  # a row per part
    manifest = (spark.read.schema(PARTS).parquet(staged).withColumn("part", F.row_number().over(place) - 1)
                .join(names, ["scan_id", "format"])
                .select("scan_id", "format", "name", "part", F.concat(F.lit("data/"), "file").alias("file"), "first", "bytes", "crc32", "rows"))
    manifest.write.parquet(f"{folder.rstrip('/')}/manifest")
    return read_manifest(spark, folder)


MANIFEST = "scan_id string, format string, name string, part int, file string, first long, bytes long, crc32 long, rows long"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def export_scans(scans: DataFrame, t: ScanTables, folder: str, formats=FORMATS, page_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-1..3, SNK-7..9: exports every scan that may be exported (or the page
    ``page_id``).  Returns the manifest and the scans refused, with the reason."""
    gate, refused = EX.export_gate(scans)
    pages = EX.page_scope(t.pages, page_id)
    names = artifact_names(gate)
    if page_id is not None:
        one = pages.select("scan_id", "url").join(gate.select("scan_id", "target_url"), "scan_id")
        named = U.export_names(one, "target_url", "url").select("scan_id", "page_basename")
        names = names.join(named, "scan_id").select("scan_id", "format", F.concat("page_basename", F.lit("."), U.export_extension("format")).alias("name"))
        gate = gate.join(one.select("scan_id"), "scan_id", "left_semi")
    return write_artifacts(export_rows(gate, ScanTables(pages, t.blocks, t.entities), formats), names, folder), refused


_DIGESTS = "scan_id string, format string, name string, bytes long, sha256 string"


def artifact_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads every artifact's parts in order: scan_id, format, name, bytes and
    SHA-256 of the whole.  A part that is not what was written raises.  Bytes
    stream through a task; none are kept."""
    import hashlib
    from itertools import groupby

    schema = pa.schema([("scan_id", pa.string()), ("format", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def read(batches):
        files, root = file_system(folder)
        rows = (r for batch in batches for r in batch.to_pylist())
        for (scan, fmt, name), parts in groupby(rows, key=lambda r: (r["scan_id"], r["format"], r["name"])):
            digest, size = hashlib.sha256(), 0
            for part in parts:
                crc = 0
                for data in read_bytes(files, f"{root}/{part['file']}", part["first"], part["bytes"]):
                    digest.update(data)
                    crc = zlib.crc32(data, crc)
                    size += len(data)
                if crc != part["crc32"]:
                    raise OSError(f"part {part['part']} of {name} is damaged")
            yield pa.RecordBatch.from_pylist([{"scan_id": scan, "format": fmt, "name": name, "bytes": size, "sha256": digest.hexdigest()}], schema=schema)
    key = ["scan_id", "format", "name"]
    return manifest.repartition(*key).sortWithinPartitions(*key, "part").mapInArrow(read, _DIGESTS)


def read_bytes(files, path: str, first: int, size: int, step: int = 1 << 20):
    """The bytes of a range of a file, piece by piece."""
    with files.open_input_file(path) as stream:
        stream.seek(first)
        while size > 0:
            data = stream.read(min(step, size))
            if not data:
                raise OSError(f"{path} ends early")
            size -= len(data)
            yield data
