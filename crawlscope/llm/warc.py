"""Deterministic sharded WARC writer and its reader (operator 11).

``write_archive`` makes one record per page: a response with the payload, or a
revisit of the page with the smallest page_id that has the same payload.

1. Every row is reduced to its page_id, a hash of the row, the payload's SHA-256,
   SHA-1 and size; equal rows are counted.  The smallest row of each payload
   becomes its response.  No payload takes part.
2. Records are ordered by ``place`` (page_id, row hash, number among equal
   rows).  Shard bounds are cut at equal shares of the archive's bytes, taken
   from rows that a hash of their place picks (at most about ``BOUNDS`` of
   them), so they depend on the data alone, never on Spark's partitions.
3. Payloads of responses go to their shard and are sorted with the records (a
   16 MB bitmap keeps most others from being sent, as far as it goes); a task
   streams its shard into gzip members, rolls to a new file once one has
   ``file_bytes`` compressed bytes, and computes headers, digests and record ids
   afresh.  Dates are a parameter.  The same pages give the same bytes.
4. Files are written under temporary names that no two attempts share.  What
   committed tasks report is saved; their files are renamed by a second job
   that may be run again, and a manifest is published last, by one rename.
   Readers see only files that a manifest names.

``read_archive`` reads the members of the manifest's files from several places
of a file at once, checks every block and payload digest, and returns a row per
record.

Files are written and read with pyarrow's file systems, so the folder may be of
any kind that these reach from executors.

Defined cases: null html is empty; null urls have no target URI, and control
characters, spaces and bytes of no UTF-8 in urls are percent-encoded; a null
page_id comes after all others and is read back as null; of equal payloads in
rows that share the smallest page_id the row with the smaller hash is the
response, and of equal rows the first; an empty table gives an archive of no
files.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.llm.store import may_belong, membership, prepare, save
from crawlscope.session import checkpoint_dir, ship_with_tasks

ship_with_tasks(sys.modules[__name__])

FILE_BYTES = 1 << 28        # compressed bytes after which a file is closed
SHARD_BYTES = 32 << 20      # of a shard's payloads and headers before compression
MOST_SHARDS = 20_000        # beyond, shards grow with the data
SPLIT_BYTES = 8 << 20       # compressed bytes that one reader takes
BOUNDS = 320_000            # rows that the shard bounds are taken from
SAME_ROWS = 10_000          # equal rows written together
MET_PLACES = 100_000        # that a task remembers, to send equal rows' payload once
HEADER_BYTES = 700          # of a record, for the shares of the shards
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_HEX5, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_FILES = ("shard long, number long, temporary string, bytes long, records long, sha256 string, "
          "splits array<struct<first:long,end:long>>")
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX5, _BASE32)


def place(page_id: Column, row: Column, number: Column) -> Column:
    """Sorts as page_id (nulls last), row hash, number among equal rows."""
    low = F.lit(-(1 << 63)).cast("long")
    return F.concat(F.when(page_id.isNull(), "1").otherwise("0"),
                    F.lpad(F.hex(F.coalesce(page_id, low).bitwiseXOR(low)), 16, "0"), row, F.lpad(F.hex(number), 12, "0"))


def _given(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    mark = F.concat(F.when(F.col("url").isNull(), "0").otherwise("1"), F.coalesce("url", F.lit("")), F.lit("\x00"), F.sha2("html", 256))
    return rows.withColumn("row", F.upper(F.substring(F.sha2(mark, 256), 1, 32)))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """What is to be written: place, page_id, row, url, size, digest, refers_to,
    revisit, and for equal rows written together their count ``n`` and ``from``,
    the number of the first.  Of a payload of ``min_bytes`` or more only the
    smallest row is a response."""
    rows = _given(pages)
    facts = (rows.select("page_id", "row", "url", F.unhex(F.sha2("html", 256)).alias("body"), F.octet_length("html").cast("long").alias("size"),
                         base32_sha1(F.col("html")).alias("digest"))
             .groupBy("page_id", "row")
             .agg(*[F.first(c).alias(c) for c in ("url", "body", "size", "digest")], F.count("*").alias("n")))
    facts = save(facts, "warc-rows")
    order = F.struct(F.col("page_id").isNull().alias("late"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))
    shared = (facts.where(F.col("size") >= min_bytes).groupBy("body").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
              .where("rows > 1").select("body", F.col("first.page_id").alias("to_page"), F.col("first.row").alias("to_row")))
    found = facts.join(shared, "body", "left")
    later = F.col("to_row").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("to_page")) & (F.col("row") == F.col("to_row")))
    found = found.withColumn("revisit", later)
    # Equal rows: the first is decided above, the others revisit it.
    small = F.col("size") < min_bytes
    steps = F.when(small, F.array(F.lit(0).cast("long"))).otherwise(
        F.concat(F.array(F.lit(0).cast("long")), F.when(F.col("n") > 1, F.sequence(F.lit(1).cast("long"), F.col("n") - 1, F.lit(SAME_ROWS).cast("long")))
                 .otherwise(F.array().cast("array<long>"))))
    found = found.withColumn("from", F.explode(steps))
    more = F.col("from") > 0
    return found.select(
        place(F.col("page_id"), F.col("row"), F.col("from")).alias("place"), "page_id", "row", "url", "size", "digest",
        (F.col("revisit") | more).alias("revisit"), F.when(F.col("revisit"), F.col("to_page")).when(more, F.col("page_id")).alias("refers_to"),
        F.when(F.col("revisit"), F.col("to_row")).when(more, F.col("row")).alias("refers_row"), "from",
        F.when(small, F.col("n")).when(~more, F.lit(1).cast("long")).otherwise(F.least(F.lit(SAME_ROWS).cast("long"), F.col("n") - F.col("from"))).alias("n"))


def shard_bounds(found: DataFrame, shard_bytes: int) -> list[str]:
    """Places at which shards begin, the first shard's left out."""
    weight = F.col("n") * (HEADER_BYTES + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size")))
    total = found.agg(F.sum(weight).alias("bytes"), F.count("*").alias("rows")).first()
    shards = min(MOST_SHARDS, -(-(total.bytes or 0) // shard_bytes))
    if shards <= 1:
        return []
    share = -(-total.rows // BOUNDS)
    seen = (found.where(F.pmod(F.xxhash64("place"), F.lit(share)) == 0).select("place", weight.alias("weight")).toArrow()
            .sort_by("place"))
    if not len(seen):
        return []
    up_to = np.cumsum(seen.column("weight").to_numpy())
    cuts = np.searchsorted(up_to, up_to[-1] * np.arange(1, shards) / shards)
    return sorted({seen.column("place")[int(i)].as_py() for i in cuts})


def _file_system(folder: str):
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", folder))
    return fs.LocalFileSystem(), folder


def _clean_uri(url: str) -> str:
    return "".join(c if "!" <= c != "\x7f" and not "\x80" <= c <= "\xa0" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
                   for c in url)


def record_id(page_id: int | None, row: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{row}:{number}')}>"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *((k, v) for k, v in headers if v is not None),
            ("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(r: dict, number: int, payload: bytes | None, date: str) -> bytes:
    """A gzip member: the response, or without payload a revisit.  Both blocks
    start with the HTTP header, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['size']}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(r["page_id"], r["row"], number)), ("WARC-Date", date),
               ("WARC-Target-URI", None if r["url"] is None else _clean_uri(r["url"])),
               ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("X-Page-Id", r["page_id"])]
    if payload is None:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(r["refers_to"], r["refers_row"], 0)),
                    ("X-Refers-To-Page-Id", r["refers_to"])]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    return _member("revisit" if payload is None else "response", headers, http + (payload or b""))


def _info(shard: int, number: int, date: str) -> bytes:
    body = b"software: crawlscope\r\nformat: WARC File Format 1.1\r\n"
    return _member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'file:{shard}:{number}')}>"), ("WARC-Date", date),
                                ("WARC-Filename", file_name(shard, number)), ("Content-Type", "application/warc-fields")], body)


def file_name(shard: int, number: int) -> str:
    return f"pages-{shard:06d}-{number:05d}.warc.gz"


class ShardWriter:
    """Writes one shard's records into files of about ``file_bytes``."""

    def __init__(self, folder: str, shard: int, file_bytes: int, date: str):
        self.fs, self.path = _file_system(folder)
        self.shard, self.file_bytes, self.date = shard, file_bytes, date
        self.attempt, self.done, self.out = uuid.uuid4().hex, [], None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"{self.path}/_temporary/{self.shard}-{len(self.done)}-{self.attempt}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out, self.hash = self.fs.open_output_stream(self.name), hashlib.sha256()
            self.size, self.records, self.splits = 0, -1, [0]
            self.add(_info(self.shard, len(self.done), self.date))
        if self.size - self.splits[-1] >= SPLIT_BYTES:
            self.splits.append(self.size)
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.file_bytes:
            self._end_file()

    def close(self) -> list[dict]:
        """What was written, a row per file."""
        self._end_file()
        return self.done

    def _end_file(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            ends = [*self.splits[1:], self.size]
            self.done.append({"shard": self.shard, "number": len(self.done), "temporary": self.name.rsplit("/", 1)[1], "bytes": self.size,
                              "records": self.records, "sha256": self.hash.hexdigest(),
                              "splits": [{"first": a, "end": b} for a, b in zip(self.splits, ends) if b > a]})


_FILE_ROWS = pa.schema([("shard", pa.int64()), ("number", pa.int64()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()),
                        ("sha256", pa.string()), ("splits", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])


def write_archive(pages: DataFrame, folder: str, *, date: str = DATE, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES,
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes an archive of ``pages`` (page_id, url, html) to ``folder``, which
    must hold none, and returns its manifest (a row per file)."""
    spark = pages.sparkSession
    prepare(spark)
    fs, path = _file_system(folder)
    if fs.get_file_info(f"{path}/manifest").type.name != "NotFound":
        raise FileExistsError(f"{folder} holds an archive")
    fs.create_dir(path, recursive=True)
    found = save(records(pages, min_bytes), "warc-records")
    bounds = shard_bounds(found, shard_bytes)
    shared = spark.sparkContext.broadcast(np.array(bounds, dtype="S65"))
    wanted = membership(found.where("not revisit").select(F.xxhash64("place")))

    def shard_of(places: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, np.array(places.to_pylist(), dtype="S65"), side="right"), pa.int32())

    def deal(batches):
        """Adds the shard, drops payloads that no response needs, and of a
        payload that a task meets again for the same place all but the first."""
        met = set()
        for batch in batches:
            held = may_belong(wanted.value, batch.column("hash").to_numpy())
            places = batch.column("place").to_pylist()
            for i in np.flatnonzero(held).tolist():
                held[i] = places[i] not in met
                met.add(places[i])
            if len(met) > MET_PLACES:
                met.clear()
            batch = batch.filter(pa.array(held, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("html"), shard_of(batch.column("place"))], names=["place", "html", "shard"])

    def deal_plan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, shard_of(batch.column("place"))], names=[*batch.schema.names, "shard"])

    first = place(F.col("page_id"), F.col("row"), F.lit(0).cast("long"))
    body = _given(pages).select(first.alias("place"), F.xxhash64(first).alias("hash"), "html").mapInArrow(deal, "place string, html string, shard int")
    plan = found.mapInArrow(deal_plan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields) + ", shard int")
    rows = plan.withColumn("kind", F.lit(0)).unionByName(body.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("place", "kind")

    def write(batches):
        """A record's plan comes first, then its payload, if it has one."""
        writer, done, due = None, [], None
        for batch in batches:
            bodies = batch.column("html")
            for i, record in enumerate(batch.select([c for c in batch.schema.names if c != "html"]).to_pylist()):
                if record["kind"] == 0:
                    if due is not None:
                        raise RuntimeError(f"no payload came for page {due['page_id']}")
                    if writer is None or writer.shard != record["shard"]:
                        if writer is not None:
                            done += writer.close()
                        writer = ShardWriter(folder, record["shard"], file_bytes, date)
                    due = None if record["revisit"] else record
                    for k in range(record["n"] if record["revisit"] else 0):
                        writer.add(page_record(record, record["from"] + k, None, date))
                elif due is not None and record["place"] == due["place"]:
                    payload = bodies[i].as_py().encode("utf-8", "surrogatepass")
                    for k in range(due["n"]):
                        writer.add(page_record(due, k, payload, date))
                    due = None
        if writer is not None:
            done += writer.close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_FILE_ROWS)
    files = save(dealt.mapInArrow(write, _FILES), "warc-files")

    def publish(batches):
        files, root = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                target, source = f"{root}/{file_name(row['shard'], row['number'])}", f"{root}/_temporary/{row['temporary']}"
                if files.get_file_info(source).type.name != "NotFound":
                    files.move(source, target)
                if files.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{target} is not what its task wrote")
            yield batch
    named = files.mapInArrow(publish, _FILES).select(
        F.format_string("pages-%06d-%05d.warc.gz", "shard", "number").alias("file"), "bytes", "records", "sha256", "splits")
    staged = f"manifest-{uuid.uuid4().hex}"
    named.write.parquet(f"{folder.rstrip('/')}/{staged}")
    fs.move(f"{path}/{staged}", f"{path}/manifest")
    if fs.get_file_info(f"{path}/_temporary").type.name != "NotFound":
        fs.delete_dir(f"{path}/_temporary")  # what lost attempts left
    shared.destroy()
    wanted.destroy()
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file string, bytes long, records long, sha256 string, splits array<struct<first:long,end:long>>").parquet(
        f"{folder.rstrip('/')}/manifest")


class Members:
    """Decompressed bytes of the gzip members between two offsets of a file."""

    def __init__(self, stream, size: int):
        self.stream, self.left = stream, size
        self.raw, self.data, self.unpack = b"", bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        if not self.raw:
            if not self.left:
                return False
            self.raw = self.stream.read(min(self.left, 1 << 18))
            if not self.raw:
                raise OSError("the archive ends early")
            self.left -= len(self.raw)
        if self.unpack.eof:
            self.unpack = zlib.decompressobj(31)
        self.data += self.unpack.decompress(self.raw)
        self.raw = self.unpack.unused_data if self.unpack.eof else b""
        return True

    def line(self) -> bytes | None:
        """Up to the next CRLF, without it; None at the end."""
        start = 0
        while (cut := self.data.find(b"\r\n", start)) < 0:
            start = max(0, len(self.data) - 1)
            if not self._more():
                if self.data:
                    raise OSError("the archive ends within a record")
                return None
        out = bytes(self.data[:cut])
        del self.data[:cut + 2]
        return out

    def take(self, size: int) -> bytes:
        while len(self.data) < size:
            if not self._more():
                raise OSError("the archive ends within a record")
        out = bytes(self.data[:size])
        del self.data[:size]
        return out


def parse_records(members: Members):
    """(headers, block) of each record; digests are checked."""
    while (version := members.line()) is not None:
        if not version.startswith(b"WARC/"):
            raise OSError("no WARC record where one should begin")
        headers = {}
        while line := members.line():
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name.lower()] = value
        block = members.take(int(headers["content-length"]))
        if members.take(4) != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{_digest(block)}":
            raise OSError(f"record {headers.get('warc-record-id')} is damaged")
        yield headers, block


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_archive(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per page record of the archive: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url; ``with_payload`` adds the html
    of responses (null for revisits)."""
    prepare(spark)
    parts = read_manifest(spark, folder).select("file", F.explode("splits").alias("s")).select("file", "s.first", "s.end")
    parts = parts.repartition(max(1, parts.count()))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + (["html"] if with_payload else [])
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names])

    def read(batches):
        files, root = _file_system(folder)
        for batch in batches:
            for part in batch.to_pylist():
                rows, size = [], 0
                with files.open_input_file(f"{root}/{part['file']}") as stream:
                    stream.seek(part["first"])
                    for headers, block in parse_records(Members(stream, part["end"] - part["first"])):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?mi)^content-length: (\d+)", head).group(1))
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or _digest(payload) != digest):
                            raise OSError(f"payload of {headers['warc-record-id']} is damaged")
                        row = (_number(headers.get("x-page-id")), length, digest, kind, _number(headers.get("x-refers-to-page-id")),
                               headers.get("warc-target-uri"))
                        rows.append(row + ((payload.decode("utf-8", "surrogatepass") if kind == "response" else None,) if with_payload else ()))
                        size += len(payload) if with_payload else 0
                        if len(rows) >= 1000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return parts.mapInArrow(read, _RECORDS + (", html string" if with_payload else ""))


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Operator 11 over the whole ``pages`` table: written, then read back."""
    from crawlscope.sources.tables import load

    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(load(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).drop("url")


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') html, min(page_id) over (partition by coalesce(html, '')) first from pages)
select page_id, strlen(html)::bigint payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(sha1(html), 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::bigint, 1)), '') payload_digest,
       if(page_id = first, 'response', 'revisit') record_type, if(page_id = first, null, first) refers_to
from p
"""
