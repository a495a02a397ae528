"""Toxicity by weak supervision (operator 9).

1. Lexicon and pattern mining: document frequencies of words, word beginnings
   and symbol runs by class over at most about ``SAMPLE`` labelled rows (copies left out); the
   entries with enough evidence, all of them, are dealt into lexicons.
2. Voters: each lexicon votes "toxic" where one of its entries occurs and
   abstains otherwise; one voter says "clean" where no lexicon has an entry.
3. Generative label model: the votes of all documents are counted by pattern.
   Voters whose votes are correlated within the classes (as the labelled rows
   suggest them) are joined into one factor with a joint table, and
   expectation-maximisation over the patterns estimates the factors' tables.
4. A linear classifier over the entries' frequencies is trained on the
   posterior labels of a bounded sample of documents and scores whole texts.

Labels enter only by the mined entries and the model's starting point.  Only
the text is an input of a score.

Defined cases: null and empty texts have no entries and get the score of such
documents; without usable labels, or where nothing separates the classes, every
score is the base rate (0 without labels); repeated rows are scored alike;
extra columns of the input are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.labelled import bounded_sample, fold
from crawlscope.llm.store import prepare
from crawlscope.llm.words import byte_values, chunks, class_table, mix, string_buffers, words_of
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

SAMPLE = 20_000     # labelled rows that entries are mined from
LEXICONS = 2        # lexicons for each kind of entry: 2 ** 13 vote patterns at most
BEGINNINGS = (4, 5, 6, 8)
TRAINING = 20_000   # documents that the linear classifier is trained on
LEAST = 4           # toxic sample documents that an entry must occur in
EVIDENCE = 14.0     # least log-likelihood ratio of an entry (chance: about 2e-4)
JOIN_ABOVE = 0.3    # correlation within a class that joins two voters
THRESHOLD = 0.3
PRECISION = 0.75    # least share of an entry's sample documents that are toxic

_SYMBOL = 1 << 8
_KINDS = ("word", *(f"begins{n}" for n in BEGINNINGS), "symbols")


def features(data, offsets, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, kind, row) of everything in rows [a, b) that may be an
    entry: lower-cased words, their beginnings, runs of symbols."""
    w = words_of(data, offsets, a, b, class_table("alnum"), byte_values(lower=True))
    row = w.rows()
    hashes, kinds, rows = [w.hash], [np.zeros(len(row), np.int8)], [row]
    for k, n in enumerate(BEGINNINGS, 1):
        which, h = w.prefix_hashes(n)
        hashes.append(h)
        kinds.append(np.full(len(h), k, np.int8))
        rows.append(row[which])
    s = words_of(data, offsets, a, b, class_table("symbol"), byte_values(lower=False))
    hashes.append(s.hash ^ np.uint64(_SYMBOL))
    kinds.append(np.full(len(s.hash), len(BEGINNINGS) + 1, np.int8))
    rows.append(s.rows())
    return np.concatenate(hashes), np.concatenate(kinds), np.concatenate(rows)


def mine(docs: DataFrame, wanted: dict[int, int]) -> list[tuple[int, int, float]]:
    """[(feature hash, kind, log-likelihood ratio)] of every entry
    with enough evidence; the sample bounds their number."""
    prepare(docs.sparkSession)
    ids = np.array(sorted(wanted), dtype=np.int64)
    label = np.array([wanted[int(i)] for i in ids], dtype=bool)

    def count(batches):
        for batch in batches:
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            keep = known & np.isin(doc, ids)
            part = batch.filter(pa.array(keep))
            toxic = label[np.searchsorted(ids, doc[keep])]
            data, offsets = string_buffers(part.column("text"))
            for a, b in chunks(offsets):
                h, kind, row = features(data, offsets, a, b)
                both = np.unique(np.rec.fromarrays([h, kind, row]))
                order = np.unique(both["f0"], return_index=True, return_counts=True)
                yes = np.add.reduceat(toxic[a:b][both["f2"]].astype(np.int64), order[1]) if len(both) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[0].view(np.int64)), pa.array(both["f1"][order[1]].astype(np.int32)),
                     pa.array(yes), pa.array(order[2].astype(np.int64) - yes)], names=["h", "kind", "yes", "no"])

    rate = float(label.mean())
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(count, "h long, kind int, yes long, no long")
            .groupBy("h", "kind").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
            .where((F.col("yes") >= LEAST) & (F.col("yes") >= PRECISION * (F.col("yes") + F.col("no"))))
            .withColumn("g", 2 * (F.col("yes") * F.log(F.col("yes") / ((F.col("yes") + F.col("no")) * rate))
                                  + F.when(F.col("no") > 0, F.col("no") * F.log(F.col("no") / ((F.col("yes") + F.col("no")) * (1 - rate)))).otherwise(0.0)))
            .where(F.col("g") > EVIDENCE).orderBy(F.desc("g"), "h").collect())
    return [(r.h, r.kind, r.g) for r in rows]


def unrelated(docs: DataFrame, wanted: dict[int, int]) -> dict[int, int]:
    """``wanted`` without copies: of sample rows that share one of three
    minimum hashes over four-word windows only the smallest doc_id stays, so a
    copied text does not lend weight to its words."""
    ids = np.array(sorted(wanted), dtype=np.int64)

    def sign(batches):
        for batch in batches:
            part = batch.filter(pa.array(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                                         & np.isin(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), ids)))
            data, offsets = string_buffers(part.column("text"))
            out = np.zeros((part.num_rows, 3), dtype=np.int64)
            for a, b in chunks(offsets):
                w = words_of(data, offsets, a, b, class_table("alnum"), byte_values(lower=True))
                row = w.rows()
                h = w.window_hashes(4)[w.windows_inside(4)]
                at = row[:max(0, len(row) - 3)][w.windows_inside(4)]
                if len(h):
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    for k in range(3):
                        out[a + at[first], k] = np.minimum.reduceat(mix(h + np.uint64(k)), first).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[:, k]) for k in range(3))], names=["doc_id", "a", "b", "c"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(sign, "doc_id long, a long, b long, c long").toPandas().sort_values("doc_id"))
    seen, kept = set(), {}
    for doc, *marks in rows.itertuples(index=False):
        marks = {(k, m) for k, m in enumerate(marks) if m}
        if not marks & seen:
            kept[doc] = wanted[doc]
        seen |= marks
    return kept


class Lexicons:
    """The mined entries: sorted hashes, their columns and their lexicons."""

    def __init__(self, entries: list[tuple[int, int, float]]):
        ranked = sorted(entries, key=lambda e: (e[1], -e[2], e[0]))
        lexicon, seen = {}, {}
        for h, kind, _ in ranked:  # dealt in turn, so each kind's lexicons are alike
            turn = seen[kind] = seen.get(kind, -1) + 1
            lexicon[h] = (kind, turn % LEXICONS)
        names = sorted(set(lexicon.values()))
        self.hashes = np.array(sorted(lexicon), dtype=np.int64).view(np.uint64)
        order = np.argsort(self.hashes)
        signed = np.array(sorted(lexicon), dtype=np.int64)[order]
        self.hashes = self.hashes[order]
        self.voter = np.array([names.index(lexicon[int(h)]) for h in signed], dtype=np.int64)
        self.voters = len(names) + 1  # the last one says "clean"
        self.size = len(signed)

    def matrix(self, column) -> np.ndarray:
        """Rows x entries: log of one plus the occurrences of each entry."""
        data, offsets = string_buffers(column)
        out = np.zeros((len(offsets) - 1, self.size), dtype=np.float32)
        for a, b in chunks(offsets):
            h, _, row = features(data, offsets, a, b)
            if not self.size or not len(h):
                continue
            at = np.searchsorted(self.hashes, h)
            at[at == self.size] = 0
            hit = self.hashes[at] == h
            np.add.at(out, (row[hit] + a, at[hit]), 1)
        return np.log1p(out)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Pattern number of each row: bit v is set where voter v votes."""
        fired = np.zeros((len(x), self.voters), dtype=bool)
        for v in range(self.voters - 1):
            fired[:, v] = x[:, self.voter == v].any(axis=1)
        fired[:, -1] = ~fired[:, :-1].any(axis=1)
        return fired @ (1 << np.arange(self.voters, dtype=np.int64))


class LabelModel:
    """Two latent classes over vote patterns, with factors of joined voters."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, voters: int, start: np.ndarray, rounds: int = 60):
        self.bits = (patterns[:, None] >> np.arange(voters)) & 1
        self.patterns, self.n = patterns, counts.astype(float)
        # Correlations are taken under the starting posterior: a model fitted
        # without them would take a pair of copied voters for the class itself.
        self.factors = self._join(start, voters)
        self.posterior = self._fit(self.factors, start, rounds)

    def _cells(self, factor):
        return self.bits[:, factor] @ (1 << np.arange(len(factor)))

    def _fit(self, factors, posterior, rounds):
        for _ in range(rounds):
            weight = np.stack([self.n * (1 - posterior), self.n * posterior])
            score = np.log((weight.sum(axis=1) + 1) / (weight.sum() + 2))[:, None].repeat(len(self.n), 1)
            for f in factors:
                cell = self._cells(f)
                for y in (0, 1):
                    table = np.bincount(cell, weight[y], 1 << len(f)) + 0.1
                    score[y] += np.log(table / table.sum())[cell]
            posterior = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        return posterior

    def _join(self, posterior, voters):
        """Groups of at most four voters whose votes are correlated given the
        class, the strongest pairs first."""
        strength = np.zeros((voters, voters))
        for y in (0, 1):
            w = self.n * (posterior if y else 1 - posterior)
            if w.sum() < 1:
                continue
            mean = (w @ self.bits) / w.sum()
            centred = self.bits - mean
            cov = (centred * w[:, None]).T @ centred / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            strength = np.maximum(strength, np.abs(cov / np.outer(sd, sd)) * (sd[:, None] > 1e-3) * (sd[None, :] > 1e-3))
        group = list(range(voters))
        for a, b in sorted(((a, b) for a in range(voters) for b in range(a)), key=lambda p: -strength[p]):
            if strength[a, b] > JOIN_ABOVE and group[a] != group[b] and group.count(group[a]) + group.count(group[b]) <= 4:
                group = [group[a] if g == group[b] else g for g in group]
        return [[v for v in range(voters) if group[v] == g] for g in sorted(set(group))]


def train_linear(x: np.ndarray, target: np.ndarray, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam."""
    w, c = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + c, -40, 40)))
        e = (p - target) / max(1, len(x))
        g = np.append(x.T @ e + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, c = w - step[:-1], c - step[-1]
    return w, float(c)


def fit(docs: DataFrame, labels: DataFrame, column: str, allowed, sample: int = SAMPLE):
    """(lexicons, weights, constant) of the classifier."""
    prepare(docs.sparkSession)
    wanted = bounded_sample(labels, column, allowed, sample)
    rate = float(np.mean(list(wanted.values()))) if wanted else 0.0
    distinct = unrelated(docs, wanted) if 0 < rate < 1 else {}
    lexicons = Lexicons(mine(docs, distinct) if len(set(distinct.values())) == 2 else [])
    if not lexicons.size:
        return lexicons, np.zeros(0), float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    ids = np.array(sorted(wanted), dtype=np.int64)
    toxic = np.array([wanted[int(i)] for i in ids], dtype=bool)

    def vote(batches):
        for batch in batches:
            x = lexicons.matrix(batch.column("text"))
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            labelled = known & (ids[at] == doc)
            chosen = batch.column("chosen").to_numpy(zero_copy_only=False)
            bags = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) if c else ([], []) for r, c in zip(x, chosen)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lexicons.votes(x)), pa.array(np.where(labelled, np.where(toxic[at], 1, 0), -1).astype(np.int32)),
                 batch.column("chosen"), pa.array([b[0] for b in bags], pa.list_(pa.int32())),
                 pa.array([b[1] for b in bags], pa.list_(pa.float32()))], names=["pattern", "y", "chosen", "at", "amount"])

    n = docs.count()
    share = 1_000_000 if n <= TRAINING else int(1_000_000 * TRAINING / n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.pmod(F.xxhash64(F.lit("training"), "doc_id"), F.lit(1_000_000)) < share).alias("chosen"))
    voted = rows.mapInArrow(vote, "pattern long, y int, chosen boolean, at array<int>, amount array<float>")
    table = voted.groupBy("pattern").agg(
        F.count("*").alias("n"), F.sum((F.col("y") == 1).cast("long")).alias("yes"), F.sum((F.col("y") == 0).cast("long")).alias("no")).toPandas()
    start = (table.yes + 2 * rate) / (table.yes + table.no + 2)
    model = LabelModel(table.pattern.to_numpy(), table.n.to_numpy(), lexicons.voters, start.to_numpy())
    posterior = dict(zip(model.patterns.tolist(), model.posterior.tolist()))
    bags = voted.where("chosen").select("pattern", "at", "amount").limit(2 * TRAINING).collect()
    x = np.zeros((len(bags), lexicons.size), dtype=np.float32)
    for k, r in enumerate(bags):
        x[k, r["at"]] = r["amount"]
    w, c = train_linear(x, np.array([posterior[r.pattern] for r in bags]))
    return lexicons, w, c


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``score``, every text scored whole."""
    lexicons, w, c = model
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            z = lexicons.matrix(batch.column(batch.num_columns - 1)) @ w + c if lexicons.size else np.full(batch.num_rows, c)
            s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s.astype(np.float64))], names=[*keep, "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("__scored"))
    return rows.mapInArrow(run, rows.drop("__scored").schema.add("score", "double"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over all ``documents``, fitted on ``labels.toxic`` of rows
    whose fold (crc32 of doc_id modulo 4) is not 2."""
    from crawlscope.sources.tables import load

    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
