"""Line dedup by a segment-partition edit join (operator 1).

Lines of at least ``LEAST`` characters are near copies when their edit distance
is at most ``EDITS``.  A line of length n is cut into EDITS + 1 segments; of
two lines within that distance the longer one holds one of the shorter one's
segments nearly in place, so the longer line probes, for every shorter length
in reach, just the substrings whose shift the edits left and right of the
segment allow.  Segments and probes are keys of one equi-join (length, segment
number, substring hash).  Candidates are verified by a banded bit-parallel edit
distance that runs over many pairs at once, and ``linkage`` closes the links to
classes without listing the pairs of a class.

Of each class only the first line (smallest doc_id, then line number) stays.

Defined cases: null texts have no lines, an empty text has one empty line;
lines are split at line feeds only and compared as they stand; shorter lines
are never removed; rows that share a doc_id count as one document, each
loses lines of its own text (``mark``, a hash, tells texts apart); rows with a
null doc_id take no part and keep their text.  Extra columns are kept.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.linkage import components_of_shared, shared_keys
from crawlscope.llm.store import may_belong, membership, prepare, save
from crawlscope.llm.words import mix, powers
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

EDITS = 2
LEAST = 24
BAND = 8  # links are decided, and most distances measured, within this many edits
GRAM = 4  # code points of the substrings that tell lines of one key apart
WIDE = 31  # further distances are exact up to this many edits
CHUNK_CHARS = 1 << 17


def line_chunks(texts: list[str | None]):
    """(rows, code points, start, end, row, number) of runs of texts: one entry
    of the arrays per line; ``rows`` are the indexes of the texts."""
    run, load = [], 0
    for r, t in enumerate(texts):
        if t is None:
            continue
        run.append(r)
        load += len(t) + 1
        if load >= CHUNK_CHARS:
            yield _lines(texts, run)
            run, load = [], 0
    if run:
        yield _lines(texts, run)


def _lines(texts, run):
    joined = "\n".join(texts[r] for r in run)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    feeds = np.flatnonzero(points == 10)
    start, end = np.concatenate([[0], feeds + 1]), np.concatenate([feeds, [len(points)]])
    size = np.array([texts[r].count("\n") + 1 for r in run])
    row = np.repeat(np.array(run), size)
    number = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return points, start, end, row, number


class Hashes:
    """Hash of any substring of a run of code points, by one prefix sum."""

    def __init__(self, points: np.ndarray):
        up, self.down = powers("points").upto(len(points))
        self.total = np.zeros(len(points) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            value = (points.astype(np.uint64) + np.uint64(7)) * np.uint64(0x9FB21C651E98DF25)
            value ^= value >> np.uint64(28)
            np.cumsum(value * up[:len(points)], out=self.total[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[start + size] - self.total[start]) * self.down[start]


def line_nodes(h: Hashes, start, end) -> np.ndarray:
    """Signed 64-bit fingerprint of each line."""
    return mix(h.of(start, end - start) + mix((end - start).astype(np.uint64))).view(np.int64)


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of lines of these lengths: EDITS + 1 segments,
    the longer ones last."""
    size, longer = np.divmod(length, edits + 1)
    short = edits + 1 - longer
    return i * size + np.maximum(0, i - short), size + (i >= short)


def segment_keys(h: Hashes, start, length, edits: int):
    """Yields (which lines, keys): own segments and probes of shorter lengths.

    Segment i (from 0) of a line shorter by ``less`` may be shifted by at most
    i edits before it, and by at most edits - i after it, counted from the
    end."""
    for less in range(edits + 1):
        other = length - less
        for i in range(edits + 1):
            at, size = segment(other, i, edits)
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                p = at + shift
                ok = np.flatnonzero((p >= 0) & (p + size <= length) & (size > 0))
                tag = (other[ok].astype(np.uint64) << np.uint64(8)) + np.uint64(i)
                yield ok, mix(h.of(start[ok] + p[ok], size[ok]) ^ mix(tag))


def banded_distance(first: list[str], second: list[str], band: int = BAND) -> np.ndarray:
    """Edit distances in code points, exact up to ``band``, else band + 1.

    Bit b of a word stands for the pattern character b - band places from the
    text's current one; vertical differences are kept as two bit vectors and
    the distance is followed along the diagonal of the end cell."""
    n = len(first)
    long_ = [a if len(a) >= len(b) else b for a, b in zip(first, second)]
    short = [b if len(a) >= len(b) else a for a, b in zip(first, second)]
    size_l, size_s = np.array([len(x) for x in long_]), np.array([len(x) for x in short])
    out = np.full(n, band + 1, dtype=np.int64)
    left = np.flatnonzero(size_l - size_s <= band)
    left = left[np.argsort(size_l[left], kind="stable")]
    a = 0
    while a < len(left):  # slices of similar lengths, of about four million characters
        b = a + 1
        while b < len(left) and (b - a) * (size_l[left[b]] + 1) < 4_000_000 and b - a < 1 << 15:
            b += 1
        part = left[a:b]
        out[part] = _banded([short[k] for k in part], [long_[k] for k in part], band)
        a = b
    return out


def _matrix(texts: list[str], width: int, fill: int, pad: int) -> np.ndarray:
    """Characters by column (width + 2 pad rows), padded with ``fill``."""
    out = np.full((len(texts), width + 2 * pad), fill, dtype=np.int32)
    for k, t in enumerate(texts):
        out[k, pad:pad + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return np.ascontiguousarray(out.T)


def _banded(short: list[str], long_: list[str], band: int) -> np.ndarray:
    width = max(len(x) for x in long_)
    pattern, text = _matrix(short, width, -1, band + 1), _matrix(long_, width, -2, 0)
    size = np.array([len(x) for x in long_])
    more = size - np.array([len(x) for x in short])
    word = np.uint32 if band < 16 else np.uint64  # 2 band + 1 bits, and one for the carry
    mask = word((1 << (2 * band + 1)) - 1)
    one = word(1)
    plus = np.full(len(short), int(mask) & ~((1 << band) - 1), dtype=word)
    minus = np.zeros(len(short), dtype=word)
    follow = (band - more).astype(word)
    d = more.astype(np.int64)
    out, left = np.full(len(short), band + 1, dtype=np.int64), np.arange(len(short))
    for j in range(width):
        if j % 16 == 15:  # pairs at their end, and beyond the band, as d never falls, are done
            done = (size <= j) | (d > band)
            if done.sum() >= len(d) / 4:
                out[left[done]] = np.minimum(d[done], band + 1)
                keep = np.flatnonzero(~done)
                left, size, more, plus, minus, follow, d = (x[keep] for x in (left, size, more, plus, minus, follow, d))
                if not len(left):
                    break
                pattern, text = np.ascontiguousarray(pattern[:, keep]), np.ascontiguousarray(text[:, keep])
        same = np.zeros(len(d), dtype=word)
        for b in range(2 * band + 1):
            same |= (pattern[j + b + 1] == text[j]).astype(word) << word(b)
        diagonal = ((((same & plus) + plus) ^ plus) | same | minus) & mask
        up = (minus | ~(diagonal | plus)) & mask
        down = diagonal & plus
        d += ((j >= more) & (j < size) & ((diagonal >> follow) & one == 0))
        plus = (down | ~((diagonal >> one) | up)) & mask
        minus = (diagonal >> one) & up
    out[left] = np.minimum(d, band + 1)
    return out


def distance_bounds(first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(near, far): both the edit distance up to WIDE; beyond, bounds that it
    cannot leave: WIDE + 1 or the difference in length, and the longer length."""
    near = banded_distance(first, second)
    size = np.array([[len(a), len(b)] for a, b in zip(first, second)], dtype=np.int64).reshape(-1, 2)
    rest = np.flatnonzero(near > BAND)
    near[rest] = banded_distance([first[k] for k in rest], [second[k] for k in rest], WIDE)
    far = np.where(near <= WIDE, near, size.max(axis=1))
    return np.where(near <= WIDE, near, np.maximum(near, np.abs(size[:, 0] - size[:, 1]))), far


def grams(line: str) -> np.ndarray:
    """Sorted hashes of a line's substrings of GRAM code points, equal ones
    numbered; an edit takes and adds at most GRAM of them."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) < GRAM:
        return np.zeros(0, dtype=np.uint64)
    start = np.arange(len(points) - GRAM + 1)
    h = np.sort(mix(Hashes(points).of(start, np.full(len(start), GRAM))))
    first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
    number = start - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.sort(mix(h + mix(number.astype(np.uint64))))


class Lines:
    """Edit distances between the distinct lines of a corpus."""

    def __init__(self, docs: DataFrame, edits: int, least: int):
        self.docs, self.edits, self.least, self.texts = docs, edits, least, None

    def occurrences(self) -> DataFrame:
        """(doc_id, mark, line, node) of the lines that take part."""
        least = self.least

        def run(batches):
            for batch in batches:
                for points, start, end, row, number in line_chunks(batch.column("text").to_pylist()):
                    keep = np.flatnonzero(end - start >= least)
                    node = line_nodes(Hashes(points), start[keep], end[keep])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[keep])) for c in ("doc_id", "mark")),
                                                      pa.array(number[keep].astype(np.int32)), pa.array(node)], names=["doc_id", "mark", "line", "node"])
        return self._plain().withColumn("mark", F.hash("text")).mapInArrow(run, "doc_id long, mark int, line int, node long")

    def keys(self) -> DataFrame:
        """(key, id) rows; each distinct line of a chunk once."""
        least, edits = self.least, self.edits

        def run(batches):
            for batch in batches:
                for points, start, end, _, _ in line_chunks(batch.column("text").to_pylist()):
                    h = Hashes(points)
                    keep = np.flatnonzero(end - start >= least)
                    node, at = np.unique(line_nodes(h, start[keep], end[keep]), return_index=True)
                    keep = keep[at]
                    for which, key in segment_keys(h, start[keep], (end - start)[keep], edits):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[which])], names=["key", "id"])
        return self._plain().mapInArrow(run, "key long, id long")

    def only(self, ids: DataFrame) -> None:
        """Keep at hand the texts of these lines."""
        least, members = self.least, membership(ids)

        def run(batches):
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for points, start, end, row, number in line_chunks(texts):
                    keep = np.flatnonzero(end - start >= least)
                    node = line_nodes(Hashes(points), start[keep], end[keep])
                    keep = keep[may_belong(members.value, node)]
                    node, at = np.unique(node[may_belong(members.value, node)], return_index=True)
                    chosen = [points[start[k]:end[k]].tobytes().decode("utf-32-le", "surrogatepass") for k in keep[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(chosen, pa.string())], names=["node", "line"])
        rows = self._plain().mapInArrow(run, "node long, line string")
        self.texts = save(rows.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").dropDuplicates(["node"]), "texts")
        members.destroy()

    def _plain(self) -> DataFrame:
        return (self.docs.where("doc_id is not null and text is not null")
                .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def _measured(self, pairs: DataFrame, measure, names: list[str]) -> DataFrame:
        def run(batches):
            for batch in batches:
                found = measure(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *map(pa.array, found)], names=["a", "b", *names])
        sides = [self.texts.select(F.col("node").alias(s), F.col("line").alias(f"line_{s}")) for s in "ab"]
        joined = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "line_a", "line_b")
        return joined.mapInArrow(run, ", ".join(f"{x} long" for x in ["a", "b", *names]))

    def compare(self, pairs: DataFrame) -> DataFrame:
        return (self._measured(pairs, lambda first, second: [banded_distance(first, second)], ["low"])
                .select("a", "b", "low", (F.col("low") <= self.edits).alias("linked")))

    def distance(self, pairs: DataFrame) -> DataFrame:
        return self._measured(pairs, distance_bounds, ["near", "far"])

    def parts(self, spokes: DataFrame) -> DataFrame:
        """Substrings that a line or its centre has more often.  Linked lines
        differ in ``within`` of them at most, so lines p and q apart from the
        centre share (p + q - within) / 2; q is above ``within`` unless near.
        Near lines share one with each other if p + q is above ``within``."""
        within = 2 * GRAM * self.edits

        def run(batches):
            for batch in batches:
                both = [batch.column(c).to_pylist() for c in ("line_a", "line_b")]
                held = {x: grams(x) for x in {*both[0], *both[1]}}  # a centre meets many
                alone = [np.setxor1d(held[x], held[y], assume_unique=True).view(np.int64) for x, y in zip(*both)]
                p = np.array([len(x) for x in alone], dtype=np.int64)
                need = np.where(p <= within, 1, np.maximum((p + 2) // 2, p - within))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array([x.tolist() for x in alone], pa.list_(pa.int64())), pa.array(p <= within), pa.array(need),
                     pa.array(np.full(len(p), within, dtype=np.int64))], names=["centre", "id", "parts", "near", "need", "within"])
        sides = [self.texts.select(F.col("node").alias(s), F.col("line").alias(f"line_{s}")) for s in "ab"]
        joined = spokes.select(F.col("centre").alias("a"), F.col("id").alias("b")).join(sides[0], "a").join(sides[1], "b").select("a", "b", "line_a", "line_b")
        return joined.mapInArrow(run, "centre long, id long, parts array<long>, near boolean, need long, within long")

    def reach(self, ids: DataFrame) -> DataFrame:
        return ids.withColumn("reach", F.lit(self.edits).cast("long"))


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, mark, line, first_doc, first_mark, first_line) of every line of
    ``least`` characters or more: the first line of its class."""
    prepare(docs.sparkSession)
    lines = Lines(docs, edits, least)
    shared = save(shared_keys(lines.keys()), "shared")
    lines.only(shared.select("id").distinct())
    found = save(components_of_shared(shared, lines.compare, lines.distance, lines.reach, lines.parts), "classes")
    rows = save(lines.occurrences(), "lines").join(found, F.col("node") == F.col("id"), "left").select(
        "doc_id", "mark", "line", F.coalesce("comp", "node").alias("class"))
    first = rows.groupBy("class").agg(F.min(F.struct("doc_id", "line", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return (rows.join(first, "class", "left")
            .select("doc_id", "mark", "line", F.coalesce("first.doc_id", "doc_id").alias("first_doc"),
                    F.coalesce("first.mark", "mark").alias("first_mark"), F.coalesce("first.line", "line").alias("first_line")))


def removals(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, mark, removed, first_docs): per document that loses lines, their
    numbers and the documents that keep them, in line order."""
    gone = line_classes(docs, edits, least).where("doc_id != first_doc or line != first_line or mark != first_mark").distinct()
    listed = gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("line", "first_doc"))).alias("gone"))
    return listed.select("doc_id", "mark", F.col("gone.line").alias("removed"), F.col("gone.first_doc").alias("first_docs"))


def deduplicate(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` without the removed lines, plus removed and first_docs (null
    where a document keeps all its lines)."""
    gone = save(removals(docs, edits, least), "removals").withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    same = (docs["doc_id"].cast("long") == gone["__id"]) & (F.hash(docs["text"].cast("string")) == gone["__mark"])
    joined = docs.drop("removed", "first_docs").join(gone, same, "left").drop("__id", "__mark")
    at, was = joined.columns.index("text"), joined.columns.index("removed")

    def cut(batches):
        for batch in batches:
            column = batch.column(at).to_pylist()
            for r, numbers in enumerate(batch.column(was).to_pylist()):
                if numbers and column[r] is not None:
                    drop = set(numbers)
                    column[r] = "\n".join(x for k, x in enumerate(column[r].split("\n")) if k not in drop)
            arrays = [pa.array(column, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
    return joined.mapInArrow(cut, joined.schema)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over the whole ``documents`` table: per document its lines
    kept and removed, the documents keeping the removed ones, and what is left (n_left counts its line
    feeds plus one)."""
    from crawlscope.sources.tables import load

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    kept = deduplicate(docs)
    n = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed"))
    text = F.coalesce("text", F.lit(""))
    left = F.when(F.col("text").isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return kept.select("doc_id", n.cast("long").alias("n_removed"), left.cast("long").alias("n_left"),
                       F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
                       F.coalesce("first_docs", F.array().cast("array<long>")).alias("first_docs"), F.sha2(text, 256).alias("kept_sha256"))
