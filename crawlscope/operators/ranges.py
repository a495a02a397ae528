"""Reading artifacts in byte ranges (SRC-4, AU-21).

An artifact may be of any size, so it is read in ranges of ``RANGE_BYTES`` that
know nothing of each other.  What a range means depends on the state in which
it begins: within quotes (CSV) or within a fence of so many backticks
(Markdown).  So a first pass makes, of each range, the map from every state at
its start to the state at its end and the number of records that start in it;
the maps of an artifact are applied one after the other, which gives each range
its true first state and record number; and a second pass cuts the range into
records.  A record that crosses ranges comes in pieces, which are put together
by its number.

Records: a CSV line with the lines its quoted cells continue on; a Markdown
section (``## `` outside fences); an element of the JSON export's page list (a
line of four blanks and a brace).  What stands before the first is record 0.

A line belongs to the range in which it starts.  A record longer than
``LONGEST`` (an unclosed quote swallows the rest of its file) keeps its number
and size, but not its text.
"""

from __future__ import annotations

import re
import sys
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.operators.artifact import file_system
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

RANGE_BYTES = 8 << 20
LONGEST = 16 << 20

RANGES = ("scan_id string, format string, name string, seq long, folder string, file string, low long, high long, "
          "first long, end long")
_KEYS = ["scan_id", "format", "name"]
_FENCE = re.compile(rb"(`{3,})(?!`)(.*)", re.S)


def part_ranges(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of written artifacts: their parts, large ones cut."""
    return _cut(manifest.select(*_KEYS, F.col("part").cast("long").alias("part"), F.lit(folder).alias("folder"), "file",
                                F.col("first").alias("low"), (F.col("first") + F.col("bytes")).alias("high")), range_bytes)


def file_ranges(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of the files below ``folder``: .json, .csv and .md files of one
    name and place are the artifacts of one scan.  Only sizes are read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
             .select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("path").alias("whole"), F.col("length").alias("high")))
    kind = F.lower(F.regexp_extract("name", "\\.([^.]*)$", 1))
    fmt = F.when(kind == "md", "markdown").when(kind.isin("json", "csv"), kind)
    files = files.withColumn("format", fmt).filter(F.col("format").isNotNull())
    return _cut(files.select(F.regexp_replace("whole", "\\.[^./]*$", "").alias("scan_id"), "format", "name", F.lit(0).cast("long").alias("part"),
                             F.regexp_extract("whole", "^(.*)/[^/]*$", 1).alias("folder"), F.col("name").alias("file"),
                             F.lit(0).cast("long").alias("low"), "high"), range_bytes)


def _cut(parts: DataFrame, range_bytes: int) -> DataFrame:
    starts = F.sequence(F.col("low"), F.greatest(F.col("high") - 1, F.col("low")), F.lit(range_bytes).cast("long"))
    cut = parts.withColumn("first", F.explode(starts))
    return cut.select(*_KEYS, (F.col("part") * 1_000_000_000 + (F.col("first") - F.col("low")) / range_bytes).cast("long").alias("seq"),
                      "folder", "file", "low", "high", "first", F.least(F.col("first") + range_bytes, F.col("high")).alias("end"))


class Line:
    """A line: its first bytes, quotes in all of it, size, and whether a line
    end was there."""

    __slots__ = ("text", "quotes", "size", "ended")

    def __init__(self, text, quotes, size, ended):
        self.text, self.quotes, self.size, self.ended = text, quotes, size, ended


def lines(r: dict, step: int = 1 << 20):
    """Lines that start in a range."""
    files, root = file_system(r["folder"])
    at = r["first"] if r["first"] == r["low"] else r["first"] - 1
    skipping = at < r["first"]  # up to the end of a line that starts before
    held, quotes, size = [], 0, 0
    with files.open_input_file(f"{root}/{r['file']}") as stream:
        stream.seek(at)
        start = at
        while at < r["high"]:
            data = stream.read(min(step, r["high"] - at))
            if not data:
                raise OSError(f"{r['file']} ends early")
            at += len(data)
            place = 0
            while place < len(data):
                cut = data.find(b"\n", place)
                end = len(data) if cut < 0 else cut
                piece = data[place:end]
                if not skipping:
                    if size <= LONGEST:
                        held.append(piece)
                    quotes += piece.count(b'"')
                    size += len(piece)
                if cut < 0:
                    break
                if not skipping:
                    yield Line(b"".join(held), quotes, size, True)
                    held, quotes, size = [], 0, 0
                skipping, place = False, cut + 1
                start = at - len(data) + place
                if start >= r["end"]:
                    return
        if size or (not skipping and start < r["high"]):
            yield Line(b"".join(held), quotes, size, False)


def step(fmt: str, state: int, line: Line) -> tuple[bool, int]:
    """Whether a record starts at ``line``, and the state behind it."""
    if fmt == "csv":
        return state == 0, state ^ (line.quotes & 1)
    if fmt == "json":
        return line.text == b"    {", 0
    if state == 0 and line.text.startswith(b"## "):
        return True, 0
    fence = _FENCE.fullmatch(line.text.rstrip(b"\r"))
    if fence is None:
        return False, state
    run = len(fence.group(1))
    if state == 0:
        return False, run
    return False, 0 if run == state and not fence.group(2).strip(b" \t") else state


def closes(line: Line) -> int:
    """The fence that a line would close, 0 if none."""
    fence = _FENCE.fullmatch(line.text.rstrip(b"\r"))
    return len(fence.group(1)) if fence and not fence.group(2).strip(b" \t") else 0


def range_map(r: dict) -> tuple[list[dict], bool]:
    """What a range does to every state it may begin in: rows (entry, state,
    starts).  A fence that the range does not close stays open, so it needs no
    row.  And whether the range's last line has a line end."""
    fmt, ended = r["format"], True
    found = {0: [0, 0]}
    if fmt == "csv":
        found[1] = [1, 0]
    for line in lines(r):
        late = closes(line) if fmt == "markdown" else 0
        for entry in found.values():
            starts, entry[0] = step(fmt, entry[0], line)
            entry[1] += starts
        if late and late not in found:
            found[late] = [0, 0]
        ended = line.ended
    return [{"entry": e, "state": s, "starts": n} for e, (s, n) in found.items()], ended


_MAPS = RANGES + ", maps array<struct<entry:int,state:int,starts:long>>, ended boolean"
_STARTS = RANGES + ", entry int, record long, state int, ended boolean, last boolean"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
             "array<struct<entry:int,state:int,starts:long>>": pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("starts", pa.int64())]))}
    return pa.schema([(c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in ddl.split(", ")])


def true_starts(ranges: DataFrame) -> DataFrame:
    """Ranges with the state and record number that they begin with (entry,
    record), the state they end in, and whether they are their artifact's last."""
    maps_schema, starts_schema = _schema(_MAPS), _schema(_STARTS)

    def first_pass(batches):
        for batch in batches:
            for r in batch.to_pylist():
                maps, ended = range_map(r)
                yield pa.RecordBatch.from_pylist([r | {"maps": maps, "ended": ended}], schema=maps_schema)

    def apply(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, parts in groupby(rows, key=lambda r: tuple(r[k] for k in _KEYS)):
            state, record, held = 0, 0, None
            for r in parts:
                if held is not None:
                    yield pa.RecordBatch.from_pylist([held | {"last": False}], schema=starts_schema)
                hit = next((m for m in r.pop("maps") if m["entry"] == state), {"state": state, "starts": 0})
                held = r | {"entry": state, "record": record, "state": hit["state"]}
                state, record = hit["state"], record + hit["starts"]
            yield pa.RecordBatch.from_pylist([held | {"last": True}], schema=starts_schema)
    spread = ranges.repartition(F.xxhash64(*_KEYS, "seq"))
    maps = spread.mapInArrow(first_pass, _MAPS)
    return maps.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "seq").mapInArrow(apply, _STARTS)


_PIECES = "scan_id string, format string, name string, record long, seq long, text string, bytes long, whole boolean"


def records(starts: DataFrame) -> DataFrame:
    """scan_id, format, name, record, text (line ends between its lines, none
    behind), bytes.  Too long a record has a null text."""
    schema = _schema(_PIECES)

    def second_pass(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from _emit(_pieces(r), schema)
    pieces = starts.repartition(F.xxhash64(*_KEYS, "seq")).mapInArrow(second_pass, _PIECES)
    from crawlscope.session import materialize

    pieces = materialize(pieces)
    key = [*_KEYS, "record"]
    split = pieces.filter(~F.col("whole"))
    sizes = split.groupBy(*key).agg(F.sum("bytes").alias("all"), F.bool_or(F.col("text").isNull()).alias("cut"))
    kept = split.join(sizes, key).withColumn("text", F.when((F.col("all") <= LONGEST) & ~F.col("cut"), F.col("text")))
    joined = kept.groupBy(*key).agg(
        F.when(F.bool_and(F.col("text").isNotNull()), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p["text"]), "")).alias("text"), F.sum("bytes").alias("bytes"))
    whole = pieces.filter("whole").select(*key, "text", "bytes")
    return whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\\n\\z", ""))


def _pieces(r: dict):
    """(record, text, bytes, whole) of a range, in order."""
    state, record, held, size, started = r["entry"], r["record"], [], 0, False
    for line in lines(r):
        starts, state = step(r["format"], state, line)
        if starts:
            if held:
                yield r, record, held, size, started
            record, held, size, started = record + 1, [], 0, True
        if size <= LONGEST:
            held.append(line.text)
            held.append(b"\n" if line.ended else b"")
        size += line.size + line.ended
    if held:
        yield r, record, held, size, False


def _emit(pieces, schema, most: int = 4 << 20):
    rows, load = [], 0
    for r, record, held, size, whole in pieces:
        text = b"".join(held).decode("utf-8", "replace") if size <= LONGEST else None
        rows.append({k: r[k] for k in _KEYS} | {"record": record, "seq": r["seq"], "text": text, "bytes": size, "whole": whole})
        load += size
        if load >= most or len(rows) >= 1000:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, load = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def artifacts(starts: DataFrame) -> DataFrame:
    """One row per artifact: scan_id, format, name, bytes, ranges, state behind
    its last byte, and whether it ends with a line end (AU-21)."""
    size = F.col("end") - F.col("first")
    return starts.groupBy(*_KEYS).agg(
        F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("ranges"), F.max(F.when(F.col("last"), F.col("state"))).alias("state"),
        F.bool_and("ended").alias("ended"))
