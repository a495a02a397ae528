"""Best-fit sequence packing (operator 10), by the sum-of-squares rule.

Documents are tokenized, cut into pieces of at most ``capacity`` tokens where
they are longer, and each piece goes where the sum of the squared counts of
open sequences per residual gap becomes smallest (an empty sequence being one
of the choices).  Pieces are dealt into groups of bounded size by a hash of
their identity and packed group by group; in a second round the sequences that
a group left open are packed again as units, across groups.

Tokenization keeps a cache of words per Python worker (``CACHE_WORDS`` entries
at most, then it starts afresh): a word's ids do not depend on its neighbours,
as the vocabulary's pre-tokenizer never joins text across white space.

Defined cases: null text is empty; an empty document is the one end token; a
text that fills a piece exactly yields no empty piece after it; repeated rows
are packed once each; a null doc_id is kept.  Strings that look like special
tokens are ordinary text.  Extra columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.store import prepare, save
from crawlscope.llm.words import worker_state
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

CAPACITY = 2048
END_ID = 0
GROUP = 16384          # pieces packed together by one call
CACHE_WORDS = 1_200_000  # per Python worker, about 240 MB

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SPACES_OF_PYTHON_ONLY = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, words: set[str]) -> None:
        """Puts every word of ``words`` into the cache.  A word of letters up to
        U+017F, perhaps with one full stop or comma behind it, is lower-cased
        and looked up by its letters; all else is encoded as it stands."""
        cache = self.cache
        plain, others = {}, []
        for w in words:
            core = w[:-1] if w[-1] in ".," else w
            if core.isalpha() and max(core) < "ƀ":
                plain[w] = (core.lower(), w[len(core):])
            else:
                others.append(w)
        needed = [x for x in {x for pair in plain.values() for x in pair if x} if x not in cache]
        letters = [x for x in needed if x.isalpha()]
        if letters:
            e = self.tokenizer.encode(" ".join(letters), add_special_tokens=False)
            ids = np.asarray(e.ids, dtype="<u4")
            cuts = np.flatnonzero(np.diff(np.asarray(e.word_ids, dtype=np.int64), prepend=-1, append=len(letters)))
            if len(cuts) == len(letters) + 1:
                raw = ids.tobytes()
                cache.update((x, raw[4 * a:4 * b]) for x, a, b in zip(letters, cuts[:-1].tolist(), cuts[1:].tolist()))
            else:  # some word was not a single pre-token
                cache.update(zip(letters, self._direct(letters)))
        others += [x for x in needed if not x.isalpha()]
        if others:
            cache.update(zip(others, self._direct(others)))
        for w, (core, mark) in plain.items():
            if w not in cache:
                cache[w] = cache[core] + cache[mark] if mark else cache[core]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if any(c in t for c in _SPACES_OF_PYTHON_ONLY) else t.split() for t in texts]
        words = set().union(*(s for s in split if s))
        missing = words.difference(self.cache)
        if len(self.cache) + 2 * len(missing) > CACHE_WORDS:
            self.cache, missing = {}, words
        if missing:
            self._learn(missing)
        look = self.cache.__getitem__
        return [self._direct([t])[0] if s is None else b"".join(map(look, s)) for t, s in zip(texts, split)]


def encoder(path: str) -> Encoder:
    state = worker_state()
    if ("encoder", path) not in state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state["encoder", path] = Encoder(path)
    return state["encoder", path]


def _runs(texts: list[str], size: int = 4 << 20):
    """Slices of ``texts`` of about ``size`` characters."""
    run, load = [], 0
    for t in texts:
        run.append(t)
        load += len(t)
        if load >= size:
            yield run
            run, load = [], 0
    if run:
        yield run


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document; ``with_ids`` adds their ids (binary,
    little-endian uint32)."""
    prepare(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, index, piece, start, length, crc, ids = 0, [], [], [], [], [], []
            for raw in chain.from_iterable(encoder(vocabulary).encode(run) for run in _runs(texts)):
                raw += END_ID.to_bytes(4, "little")
                n = len(raw) // 4
                for k, a in enumerate(range(0, n, capacity)):
                    part = raw[4 * a:4 * (a + capacity)]
                    index.append(rows)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                rows += 1
            columns = [batch.column("doc_id").take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each size, placed in the order given.

    With N(g) open sequences of residual gap g, moving one from gap g to g - s
    changes the sum of squares by 2 (N(g - s) - N(g) + 1), by 1 - 2 N(g) where
    it becomes full, and opening a new one by 2 N(capacity - s) + 1.  Ties go
    to the smaller gap, then to an open sequence."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_ = [[] for _ in range(capacity + 1)]
    sequence = np.empty(len(sizes), dtype=np.int64)
    offset = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        best, gap = (2 * int(count[capacity - s]) + 1 if s < capacity else 0), capacity
        fits = np.flatnonzero(count[s:]) + s
        if len(fits):
            change = 2 * (count[fits - s] - count[fits] + 1)
            if fits[0] == s:
                change[0] = 1 - 2 * count[s]
            k = int(np.argmin(change))
            if change[k] <= best:
                gap = int(fits[k])
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_[gap].pop()
            count[gap] -= 1
        if gap > s:
            open_[gap - s].append(b)
            count[gap - s] += 1
        sequence[i], offset[i] = b, capacity - gap
    return sequence, offset


def _round(units: DataFrame, keys: list[str], capacity: int, total: int, mark: int) -> DataFrame:
    """One round over ``units`` (keys, length): adds sequence_id and offset.
    Group numbers take the bits above 32 of a sequence_id, ``mark`` those above
    56, so rounds never share one."""
    groups = 1 if total <= 256 else max(4, -(-total // GROUP))
    dealt = units.withColumn("g", F.pmod(F.xxhash64(*keys), F.lit(groups)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *keys], ascending=[False, *[True] * len(keys)], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        base = (mark << 56) | (int(rows["g"].iloc[0]) << 32)
        return rows.drop(columns="g").assign(sequence_id=base + sequence, offset=offset)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields)
    return dealt.groupBy("g").applyInPandas(pack, fields + ", sequence_id long, offset long")


def pack(units: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1..capacity."""
    units = save(units.withColumn("unit", F.monotonically_increasing_id()), "pieces")
    small = units.where(F.col("length") < capacity).select("unit", "length")
    first = save(_round(small, ["unit"], capacity, small.count(), 1), "packed")
    fill = first.groupBy("sequence_id").agg(F.sum("length").alias("length"))
    loose = save(fill.where(F.col("length") < capacity).withColumnRenamed("sequence_id", "old"), "open")
    again = _round(loose, ["old"], capacity, loose.count(), 2).select(
        "old", F.col("sequence_id").alias("new"), F.col("offset").alias("shift"))
    placed = (first.withColumnRenamed("sequence_id", "old").join(again, "old", "left")
              .select("unit", F.coalesce("new", "old").alias("sequence_id"),
                      (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))
    whole = units.where(F.col("length") >= capacity).withColumns(
        {"sequence_id": F.col("unit").bitwiseOR(F.lit(3 << 60)), "offset": F.lit(0).cast("long")})
    return units.join(placed, "unit").unionByName(whole).drop("unit")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Operator 10 over the whole ``documents`` table."""
    from crawlscope.sources.tables import load

    return pack(pieces(load(spark, sf_dir, "documents"), default_vocabulary()))
