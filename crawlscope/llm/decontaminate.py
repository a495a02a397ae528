"""Benchmark decontamination (operator 4).

The benchmark's normalised word windows become a sorted hash array shared with
every task; training texts are scanned window by window, each hit is verified
word by word, and the covered words are reported, cut out, or the document is
dropped.

Size bound: one array holds at most ``MAX_WINDOWS`` windows.  A larger
benchmark is worked off in blocks of that size, each scanned against all rows
and adding to a document's hits, so memory never grows with it.

Defined cases: null and empty texts have no words; an item of fewer than
``size`` words (but not none) is one window; items without words never occur;
repeated item_ids count once; a null item_id is the empty string; documents
with a null doc_id are judged like any other row.  Columns named like the
results are replaced in the report and untouched in the filter's output.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.store import prepare
from crawlscope.llm.words import byte_values, chunks, class_table, string_buffers, words_of
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

WINDOW = 10
MAX_WINDOWS = 2_000_000  # 16 MB of hashes a block

_OPEN = "doc_id long, spans array<long>, items array<string>, text string"
_DONE = "doc_id long, spans array<long>, items array<string>, n_words long"


class WindowSet:
    """Window hashes of some benchmark items, by window length."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        table, values = class_table("alnum"), byte_values(lower=True)
        data, offsets = string_buffers(pa.array([t for _, t in items], pa.large_string()))
        w = words_of(data, offsets, 0, len(items), table, values)
        found: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        hashed: dict[int, np.ndarray] = {}
        for k, (item, _) in enumerate(items):
            a, b = int(w.first[k]), int(w.first[k + 1])
            length = min(size, b - a)
            if not length:
                continue
            if length not in hashed:
                hashed[length] = w.window_hashes(length)
            for i in range(a, b - length + 1):
                found[length][int(hashed[length][i])].add((item, word_key(w, i, length)))
        self.by_length = {n: (np.array(sorted(h), dtype=np.uint64), dict(h)) for n, h in found.items()}


def word_key(w, i: int, length: int) -> bytes:
    """The lower-cased words of a window, one space between."""
    return b" ".join(w.data[w.start[k]:w.end[k]].tobytes() for k in range(i, i + length)).lower()


def scan_batch(w, windows: dict) -> tuple[list[tuple[int, int]], list[tuple[int, str]]]:
    """Verified hits of a slice: ([(first word, end word)], [(row, item)])."""
    covered, items = [], []
    row = w.rows()
    for length, (hashes, members) in windows.items():
        h = w.window_hashes(length)
        if not len(h):
            continue
        at = np.searchsorted(hashes, h)
        at[at == len(hashes)] = 0
        for i in np.flatnonzero((hashes[at] == h) & w.windows_inside(length)):
            key = word_key(w, i, length)
            owners = [item for item, k in members[int(h[i])] if k == key]
            if owners:
                covered.append((int(i), int(i) + length))
                items.extend((int(row[i]), o) for o in owners)
    return covered, items


def _scanner(windows: dict, last: bool):
    """Adds one block's hits to (doc_id, spans, items, text); the last block
    replaces the text by its count of words."""
    def scan(batches):
        table, values = class_table("alnum"), byte_values(lower=True)
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            for a, b in chunks(offsets):
                w = words_of(data, offsets, a, b, table, values)
                n_words[a:b] = np.diff(w.first)
                covered, owned = scan_batch(w, windows)
                flags = hit_flags(covered, len(w.hash))
                owners = defaultdict(set)
                for r, item in owned:
                    owners[r].add(item)
                for r, found in owners.items():
                    lo, hi = w.first[r], w.first[r + 1]
                    spans[a + r] = sorted({*spans[a + r], *np.flatnonzero(flags[lo:hi]).tolist()})
                    items[a + r] = sorted({*items[a + r], *found})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())),
                 pa.array(n_words) if last else batch.column("text")],
                names=["doc_id", "spans", "items", "n_words" if last else "text"])
    return scan


def hit_flags(covered: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words lie in any of the covered ranges."""
    step = np.zeros(n + 1, dtype=np.int64)
    for i, j in covered:
        step[i] += 1
        step[j] -= 1
    return np.cumsum(step)[:-1] > 0


def benchmark_blocks(benchmark: DataFrame, size: int, max_windows: int):
    """Window sets of at most about ``max_windows`` windows each.  Items stream
    through the driver one partition at a time; a block is freed before the
    next is filled."""
    block, load = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                            F.col("text").alias("t")).where("t is not null").distinct()
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        load += 1 + len(r.t) // 2
        if load >= max_windows:
            yield WindowSet(block, size).by_length
            block, load = [], 0
    yield WindowSet(block, size).by_length


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
                   max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, spans (indexes of the hit words), items."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"),
                       F.col("text").cast("string").alias("text"))
    blocks = benchmark_blocks(benchmark, size, max_windows)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        rows = rows.mapInArrow(_scanner(block, following is None), _DONE if following is None else _OPEN)
        block = following
    return rows


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document with its counts of words, hit words and items."""
    hits = benchmark_hits(docs, benchmark, size)
    return hits.select(
        "doc_id", "n_words", F.size("spans").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def _dropper(windows: dict):
    """Leaves out the rows that hold a window."""
    def run(batches):
        table, values = class_table("alnum"), byte_values(lower=True)
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            clean = np.ones(batch.num_rows, dtype=bool)
            for a, b in chunks(offsets):
                _, owned = scan_batch(words_of(data, offsets, a, b, table, values), windows)
                clean[[a + r for r, _ in owned]] = False
            yield batch if clean.all() else batch.filter(pa.array(clean))
    return run


def _marker(windows: dict, spans_col: str):
    """Adds the hit words' indexes to ``spans_col``; texts stay as they are."""
    def run(batches):
        table, values = class_table("alnum"), byte_values(lower=True)
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            at = batch.schema.get_field_index(spans_col)
            spans = batch.column(at).to_pylist()
            for a, b in chunks(offsets):
                w = words_of(data, offsets, a, b, table, values)
                covered, owned = scan_batch(w, windows)
                flags = hit_flags(covered, len(w.hash)) if owned else None
                for r in {r for r, _ in owned}:
                    hit = np.flatnonzero(flags[w.first[r]:w.first[r + 1]]).tolist()
                    spans[a + r] = sorted({*spans[a + r], *hit})
            arrays = [pa.array(spans, pa.list_(pa.int64())) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
    return run


def _cutter(spans_col: str):
    """Takes the marked words out of each text, and drops the marks."""
    def run(batches):
        table, values = class_table("alnum"), byte_values(lower=True)
        for batch in batches:
            column = batch.column("text")
            data, offsets = string_buffers(column)
            texts = column.to_pylist()
            for r, spans in enumerate(batch.column(spans_col).to_pylist()):
                if spans:
                    w = words_of(data, offsets, r, r + 1, table, values)
                    flags = np.zeros(len(w.hash), dtype=bool)
                    flags[spans] = True
                    texts[r] = without_words(w, 0, flags, offsets[r:r + 2] - offsets[r])
            names = [n for n in batch.schema.names if n != spans_col]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)
    return run


def without_words(w, r: int, flags: np.ndarray, offsets: np.ndarray) -> str:
    """Row ``r`` without its hit words and the gaps between two of them."""
    keep, at = [], int(offsets[r])
    for k in range(w.first[r], w.first[r + 1]):
        if flags[k]:
            if k == w.first[r] or not flags[k - 1]:
                keep.append(w.data[at:w.start[k]].tobytes())
            at = int(w.end[k])
    keep.append(w.data[at:int(offsets[r + 1])].tobytes())
    return b"".join(keep).decode("utf-8", "replace")


def remove(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, whole: bool = True,
           max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Drop the contaminated documents (``whole``), or cut their hit words.

    What is hit is judged on the texts as given: all blocks of items mark their
    words first, then each text is cut once, so the size of the blocks changes
    nothing.
    """
    prepare(docs.sparkSession)
    if whole:
        out = docs
        for w in benchmark_blocks(benchmark, size, max_windows):
            out = out.mapInArrow(_dropper(w), docs.schema)
        return out
    spans = "spans"
    while spans in docs.columns:
        spans += "_"
    out = docs.withColumn(spans, F.array().cast("array<long>"))
    marked = out.schema
    for w in benchmark_blocks(benchmark, size, max_windows):
        out = out.mapInArrow(_marker(w, spans), marked)
    return out.mapInArrow(_cutter(spans), docs.schema)


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over the whole ``documents`` and ``benchmark`` tables."""
    from crawlscope.sources.tables import load

    return report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b0 as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
b1 as (select item, ws, least(10, len(ws)) n from b0 where len(ws) > 0),
b as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') k from (select item, ws, n, unnest(range(1, len(ws) - n + 2)) i from b1)),
lens as (select distinct n from b),
d as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') k from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from w, lens)),
h as (select doc_id, item, d.i, d.n from d join b using (n, k)),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from h) group by 1),
t as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from h) group by 1)
select w.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from w left join c using (doc_id) left join t using (doc_id)
"""
