"""N-gram Jaccard join by parity sketches (operator 7).

A document's set holds the hashes of its distinct word shingles.  Within a size
band the hashes are dealt into blocks and each block keeps the XOR of its
hashes, a 64-bit parity sketch: two sets whose symmetric difference is at most
D can differ in D blocks only, so with D + 2 + E blocks they agree in 2 + E at
least, and documents that agree in a block (same band, block and XOR) become
candidates.  Blocks of one hash or none say little; a document with at most E
of them leaves them out, else, with at most E empty ones, those; as no document
leaves out more than E blocks, and what one leaves out holds no more than what
the other may leave out, two agreements stay.  Candidates are
filtered by the Hamming distance of a 2048-bit parity sketch, a lower bound of
the symmetric difference, and verified on the whole sets.

Equal sets are one node, so exact copies never pair up; ``linkage`` finds the
components without listing the pairs of a group.  The node id is a 64-bit
fingerprint of the set.

Defined cases: null and empty texts, and texts without words, have the empty
set, link with nothing and are their own component; fewer words than a shingle
has make one shingle; repeated rows are copies, rows that share a doc_id have
texts of their own; a null doc_id takes part in links but is never a component_id unless its whole component has none.  Extra
columns are ignored.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.linkage import components_of_shared, shared_keys
from crawlscope.llm.store import discard, membership, only_members, prepare, save
from crawlscope.llm.words import byte_values, chunks, class_table, mix, string_buffers, words_of
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

SHINGLE = 4
PERCENT = 85
WORDS = 32  # 64-bit words of the filter sketch


def shingle_sets(column, size: int):
    """Per chunk of rows: (first row, [sorted distinct shingle hashes per row])."""
    data, offsets = string_buffers(column)
    table, values = class_table("graph"), byte_values(lower=True)
    for a, b in chunks(offsets):
        w = words_of(data, offsets, a, b, table, values)
        h = w.window_hashes(size)
        sets = []
        for r in range(b - a):
            lo, hi = int(w.first[r]), int(w.first[r + 1])
            if hi - lo >= size:
                sets.append(np.unique(h[lo:hi - size + 1]))
            elif hi > lo:
                rest = w.window_hashes(hi - lo)[lo:lo + 1]
                sets.append(rest)
            else:
                sets.append(h[:0])
        yield a, sets


def sets_of(column, size: int) -> list[np.ndarray]:
    """The set of each row; equal texts are taken apart once."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    known = column.dictionary_encode()
    sets = [s for _, part in shingle_sets(known.dictionary, size) for s in part]
    return [sets[k] for k in known.indices.to_pylist()]


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set of hashes."""
    with np.errstate(over="ignore"):
        both = np.array([np.bitwise_xor.reduce(s) if len(s) else 0, s.sum(dtype=np.uint64), len(s)], dtype=np.uint64)
        return int(mix(mix(both[:1]) + mix(both[1:2] + np.uint64(1)) * np.uint64(3) + both[2:]).view(np.int64)[0])


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> list[int]:
    """Smallest set size of each band: a linked partner of a set lies in its
    own band or the next one."""
    starts = [1]
    while starts[-1] <= upto:
        starts.append(max(starts[-1] + 1, (starts[-1] - 1) * 100 // percent + 1))
    return starts


def block_counts(percent: int, first: int, following: int) -> tuple[int, int]:
    """(blocks, E) of the band of sizes first .. following - 1, for pairs whose
    smaller set lies in it; (0, 0) where only equal sets can be linked."""
    most = following - 1
    differ = (100 - percent) * (most + most * 100 // percent) // (100 + percent)
    if not differ:
        return 0, 0
    spare = max(2, differ // 12 + 1)
    return differ + 2 + spare, spare


def block_keys(s: np.ndarray, percent: int) -> list[np.ndarray]:
    """Keys of a set in its own band and in the band below."""
    starts = bands(percent, max(1024, 2 * len(s)))
    own = int(np.searchsorted(starts, len(s), side="right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0:
            continue
        blocks, spare = block_counts(percent, starts[band], starts[band + 1])
        if not blocks:
            continue
        at = (mix(s + np.uint64(band)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.flatnonzero(np.diff(sorted_at, prepend=-1))
        parity = np.zeros(blocks, dtype=np.uint64)
        parity[sorted_at[first]] = np.bitwise_xor.reduceat(s[order], first)
        count = np.bincount(at, minlength=blocks)
        keys = mix(parity ^ mix(np.arange(blocks, dtype=np.uint64) + np.uint64(band << 32)))
        if (count <= 1).sum() <= spare:
            keys = keys[count > 1]
        elif (count == 0).sum() <= spare:
            keys = keys[count > 0]
        out.append(keys)
    return out


def least_agreements(n: int, percent: int) -> int:
    """How many keys a set of n hashes shares, at least, with any set linked
    with it: the blocks of the smaller one's band, less those left out and one
    for each hash by which the two may differ."""
    starts = bands(percent, max(1024, 2 * n))
    own = int(np.searchsorted(starts, n, side="right")) - 1
    least = []
    for band, other in ((own, n * 100 // percent), (own - 1, starts[own] - 1)):
        blocks, spare = block_counts(percent, starts[band], starts[band + 1]) if band >= 0 else (0, 0)
        if blocks:
            least.append(blocks - spare - (100 - percent) * (n + other) // (100 + percent))
    return max(2, min(least, default=2))


def filter_sketch(s: np.ndarray) -> np.ndarray:
    """WORDS signed 64-bit words; bit i is the parity of the hashes dealt to it."""
    bits = np.bincount((s % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def profile(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, n, node, sketch) per document."""
    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            node = np.zeros(batch.num_rows, dtype=np.int64)
            sketch = np.zeros((batch.num_rows, WORDS), dtype=np.int64)
            for a, sets in shingle_sets(batch.column("text"), size):
                for r, s in enumerate(sets, a):
                    n[r], node[r], sketch[r] = len(s), fingerprint(s), filter_sketch(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(n), pa.array(node),
                 pa.ListArray.from_arrays(np.arange(0, sketch.size + 1, WORDS, dtype=np.int32), pa.array(sketch.ravel()))],
                names=["doc_id", "row", "n", "node", "sketch"])
    return _plain(docs).withColumn("row", _row()).mapInArrow(run, "doc_id long, row long, n long, node long, sketch array<long>")


def keys_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, id) rows of every document's blocks."""
    def run(batches):
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text"), size):
                keys, ids = [], []
                for s in sets:
                    for k in block_keys(s, percent) if len(s) else ():
                        keys.append(k)
                        ids.append(np.full(len(k), fingerprint(s), dtype=np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "id"])
    return _plain(docs).mapInArrow(run, "key long, id long")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _row():
    """Hash that tells rows apart, also where they share a doc_id or have none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def most_apart(percent: int, a, b):
    """Largest symmetric difference of linked sets of sizes a and b."""
    return F.floor((a + b) * (100 - percent) / (100 + percent))


def _verifier(size: int):
    def run(batches):
        for batch in batches:
            both = [sets_of(batch.column(name), size) for name in ("text_a", "text_b")]
            far = [len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*both)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("most"), pa.array(far, pa.int64())],
                                             names=["a", "b", "most", "far"])
    return run


class Sets:
    """Distances between the sets of a profiled corpus."""

    def __init__(self, docs: DataFrame, profiles: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.nodes = save(profiles.where("n > 0").groupBy("node")
                          .agg(F.min("row").alias("row"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "nodes")
        self.texts = None

    def only(self, ids: DataFrame) -> None:
        """Keep at hand the texts of these nodes (one document each)."""
        chosen = self.nodes.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").select("node", "row")
        members = membership(chosen.select("row"))
        text = only_members(_plain(self.docs).select(_row().alias("row"), "text"), "row", chosen.select("row"), members)
        text = text.join(chosen, "row").select("node", "text")
        self.texts = save(text.dropDuplicates(["node"]), "texts")
        members.destroy()

    def _side(self, side: str) -> DataFrame:
        return self.nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))

    def _text(self, side: str) -> DataFrame:
        return self.texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))

    def _measured(self, pairs: DataFrame) -> DataFrame:
        joined = pairs.join(self._text("a"), "a").join(self._text("b"), "b").select("a", "b", "most", "text_a", "text_b")
        return joined.mapInArrow(_verifier(self.size), "a long, b long, most long, far long")

    def distance(self, pairs: DataFrame) -> DataFrame:
        return self._measured(pairs.select("a", "b", F.lit(0).cast("long").alias("most"))).select("a", "b", "far")

    def compare(self, pairs: DataFrame) -> DataFrame:
        apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        close = save(pairs.join(self._side("a"), "a").join(self._side("b"), "b")
                     .select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sum"), apart.cast("long").alias("low"),
                             most_apart(self.percent, F.col("n_a"), F.col("n_b")).cast("long").alias("most")), "close")
        exact = self._measured(close.where("low <= most").select("a", "b", "most"))
        return (close.where("low > most").select("a", "b", "low", F.lit(False).alias("linked"))
                .unionByName(exact.select("a", "b", F.col("far").alias("low"), (F.col("far") <= F.col("most")).alias("linked"))))

    def parts(self, spokes: DataFrame) -> DataFrame:
        """Hashes that a set or its centre has alone.  With d the most that
        linked sets may differ by, sets p and q apart from the centre share
        (p + q - d) / 2 of them; q is above what its size and the centre's
        allow, or the set would be near."""
        size, percent = self.size, self.percent

        def run(batches):
            for batch in batches:
                both = [sets_of(batch.column(name), size) for name in ("text_a", "text_b")]
                alone = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(*both)]
                p, at, n = (np.array([len(x) for x in z], dtype=np.int64) for z in (alone, *both))
                share, whole = 100 - percent, 100 + percent
                within = (n + n * 100 // percent) * share // whole
                more = -(-(n - at) * share // whole)  # rounded up
                need = np.maximum(1, np.maximum(-(-(p + 1 - more) // 2), p - within))
                near = p <= (n + at) * share // whole
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array([x.tolist() for x in alone], pa.list_(pa.int64())), pa.array(near), pa.array(need), pa.array(within)],
                    names=["centre", "id", "parts", "near", "need", "within"])
        joined = (spokes.select(F.col("centre").alias("a"), F.col("id").alias("b")).join(self._text("a"), "a").join(self._text("b"), "b")
                  .select("a", "b", "text_a", "text_b"))
        return joined.mapInArrow(run, "centre long, id long, parts array<long>, near boolean, need long, within long")

    def agree(self, ids: DataFrame) -> DataFrame:
        percent = self.percent

        def run(batches):
            for batch in batches:
                least = [least_agreements(n, percent) for n in batch.column("n").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(least, pa.int64())], names=["id", "agree"])
        return ids.join(self.nodes.select(F.col("node").alias("id"), "n"), "id").select("id", "n").mapInArrow(run, "id long, agree long")

    def reach(self, ids: DataFrame) -> DataFrame:
        """A set of n is linked to sets of at most n * 100 / percent."""
        n = F.col("n")
        return ids.join(self.nodes.select(F.col("node").alias("id"), "n"), "id").select(
            "id", most_apart(self.percent, n, F.floor(n * 100 / self.percent)).alias("reach"))


def _labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, row, n_shingles, comp, component_id) for every row of ``docs``;
    comp is a number of the row's component."""
    prepare(docs.sparkSession)
    profiles = save(profile(docs, size), "profile")
    sets = Sets(docs, profiles, size, percent)
    shared = save(shared_keys(keys_of(docs, size, percent)).join(sets.nodes.select(F.col("node").alias("id")), "id", "left_semi"), "shared")
    sets.only(shared.select("id").distinct())
    found = save(components_of_shared(shared, sets.compare, sets.distance, sets.reach, sets.parts, sets.agree), "components")
    for done in (shared, sets.texts, sets.nodes):
        discard(done)
    rows = profiles.select("doc_id", "row", "n", F.col("node").alias("id")).join(found, "id", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("comp"))
    lowest = rows.where("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("n_shingles > 0").join(lowest, "comp").select("doc_id", "row", "n_shingles", "comp", "component_id")
    return linked.unionByName(rows.where("n_shingles = 0").withColumn("comp", F.col("row")).withColumn("component_id", F.col("doc_id")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    return _labelled(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those linked to a smaller doc_id; of linked
    rows that share a doc_id one stays.  Rows with a null doc_id stay."""
    found = save(_labelled(docs, size, percent).where("doc_id = component_id").select("doc_id", "comp", "row"), "components")
    firsts = found.groupBy("doc_id", "comp").agg(F.min("row").alias("__first")).select("__first").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).withColumn("__row", _row()).join(firsts, F.col("__row") == F.col("__first")).drop("__row")
    if found.groupBy("row").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["__first"])
    return kept.drop("__first").unionByName(docs.where(F.col("doc_id").isNull()))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Operator 7 over the whole ``documents`` table."""
    from crawlscope.sources.tables import load

    return near_duplicates(load(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') g from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 85 * (nx.n + ny.n - i)),
e as (select x a, y b from l union all select y, x from l),
r as (select doc_id a, doc_id b from w union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, coalesce(n.n, 0) n_shingles, (select min(b) from r where r.a = w.doc_id) component_id from w left join n using (doc_id)
"""
