"""Document quality classifier (operator 2).

1. Random indexing: every token bucket has a fixed sparse ternary index
   vector; a bucket's context vector sums the index vectors of the tokens
   around its occurrences.  The sums are gathered over all texts of the corpus
   and form a table of fixed size (``BUCKETS`` x ``DIM``).
2. Documents are pooled to the mean and the spread of their tokens' vectors and
   the mean size of the step from one token's vector to the next.
3. A two-layer numpy network is fitted on at most about ``SAMPLE`` labelled
   rows (the only sample here), its probabilities calibrated by a temperature
   that a set-aside fifth of these rows chooses.

Tokens are runs of letters and digits and runs of other visible bytes.  Only
the text is an input of a score: labels, lang, source and doc_id never are.

Defined cases: null and empty texts pool to the zero vector and are scored as
such; without usable labels every score is 0.5; rows are scored one by one, so
repeated rows get the same score; extra columns of the input are ignored.
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

BUCKETS = 1 << 14
DIM = 48
POOLED = 3 * DIM
SPREAD = 2       # tokens to either side that count as context
NONZERO = 2      # entries of an index vector
HIDDEN = 32
SAMPLE = 20_000  # labelled rows that the network is fitted on
THRESHOLD = 0.3

_TABLES = (class_table("alnum"), class_table("symbol"))


def tokens(data, offsets, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every token of rows [a, b), in reading order."""
    parts = [words_of(data, offsets, a, b, t, byte_values(lower=True)) for t in _TABLES]
    start = np.concatenate([w.start for w in parts])
    order = np.argsort(start, kind="stable")
    bucket = (np.concatenate([w.hash for w in parts]) % np.uint64(BUCKETS)).astype(np.int64)[order]
    return bucket, np.concatenate([w.rows() for w in parts])[order]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs (BUCKETS x NONZERO) of the index vectors."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1))
    position = (h % np.uint64(DIM)).astype(np.int64).reshape(BUCKETS, NONZERO)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, NONZERO)
    return position, sign


def _gather(batches):
    position, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        data, offsets = string_buffers(batch.column(0))
        for a, b in chunks(offsets):
            bucket, row = tokens(data, offsets, a, b)
            seen += np.bincount(bucket, minlength=BUCKETS)
            for gap in range(1, SPREAD + 1):
                if len(bucket) <= gap:
                    break
                together = row[gap:] == row[:-gap]
                left, right = bucket[:-gap][together], bucket[gap:][together]
                for word, near in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(word * DIM + position[near, k], weights=sign[near, k], minlength=BUCKETS * DIM)
    used = np.flatnonzero(seen)
    vectors = total.reshape(BUCKETS, DIM)[used]
    for a in range(0, len(used), 2048):
        cols = [pa.array(used[a:a + 2048]), pa.array(seen[used[a:a + 2048]])]
        cols += [pa.array(vectors[a:a + 2048, j]) for j in range(DIM)]
        yield pa.RecordBatch.from_arrays(cols, names=["bucket", "seen"] + [f"c{j}" for j in range(DIM)])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM vectors from the whole corpus: unit context vector plus
    the bucket's own index vector, weighted down for common tokens.  The result
    has a fixed size whatever the corpus."""
    prepare(docs.sparkSession)
    schema = "bucket long, seen long, " + ", ".join(f"c{j} double" for j in range(DIM))
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_gather, schema)
    rows = parts.groupBy("bucket").agg(F.sum("seen").alias("seen"), *[F.sum(f"c{j}").alias(f"c{j}") for j in range(DIM)]).toArrow()
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    if not rows.num_rows:
        return out
    at = rows.column("bucket").to_numpy()
    context = np.stack([rows.column(f"c{j}").to_numpy() for j in range(DIM)], axis=1)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    position, sign = index_vectors()
    own = np.zeros((BUCKETS, DIM), dtype=np.float32)  # small whole numbers
    for k in range(NONZERO):
        np.add.at(own, (np.arange(BUCKETS), position[:, k]), sign[:, k])
    share = rows.column("seen").to_numpy() / max(1, rows.column("seen").to_numpy().sum())
    context += own[at]
    context *= (1e-3 / (1e-3 + share))[:, None]
    out[at] = context
    return out


def pool(batch_column, vectors: np.ndarray) -> np.ndarray:
    """Rows x POOLED: mean and standard deviation of each text's vectors, and
    the mean absolute step from each token's vector to the next one's."""
    data, offsets = string_buffers(batch_column)
    out = np.zeros((len(offsets) - 1, POOLED), dtype=np.float32)
    for a, b in chunks(offsets):
        bucket, row = tokens(data, offsets, a, b)
        n = np.bincount(row, minlength=b - a)
        first = np.concatenate([[0], np.cumsum(n)])
        for r in np.flatnonzero(n):
            v = vectors[bucket[first[r]:first[r + 1]]]
            out[a + r, :DIM], out[a + r, DIM:2 * DIM] = v.mean(axis=0), v.std(axis=0)
            if len(v) > 1:
                out[a + r, 2 * DIM:] = np.abs(v[1:] - v[:-1]).mean(axis=0)
    return out


class Network:
    """tanh layer, logistic output, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = 0.5
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = x - self.mean
        x /= self.scale
        aside = rng.random(len(y)) < 0.2
        fit = ~aside if len(set(y[~aside].tolist())) == 2 else np.ones(len(y), dtype=bool)
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self._adam(x[fit], y[fit].astype(float), rng)
        self.temperature = 1.0
        if aside.any() and len(set(y[aside].tolist())) == 2:
            z = self._logit(x[aside])
            choices = np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(y[aside] > 0, -z, z) / t).mean() for t in choices]
            self.temperature = float(choices[int(np.argmin(loss))])

    def _logit(self, x):
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def _adam(self, x, y, rng, passes: int = 40, size: int = 128, rate: float = 3e-3, decay: float = 1e-4):
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        steps = max(passes * len(y) // size, 1500)
        order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-steps * size // len(y)))])
        for i in range(steps):
            k = order[i * size:(i + 1) * size]
            h = np.tanh(x[k] @ self.w[0] + self.w[1])
            e = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -30, 30))) - y[k]) / len(k)
            back = np.outer(e, self.w[2]) * (1 - h * h)
            grads = [x[k].T @ back + decay * self.w[0], back.sum(axis=0), h.T @ e + decay * self.w[2], np.array([e.sum()])]
            t += 1
            step = rate * (1 - i / steps)
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                self.w[j] -= step * (m[j] / (1 - 0.9 ** t)) / (np.sqrt(v[j] / (1 - 0.999 ** t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def vectors_of(column, width: int) -> np.ndarray:
    """Rows x ``width`` doubles of a column of lists, none of them null: taken
    from its buffers, as Python numbers would take twelve times their room."""
    return np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in column.chunks)]).reshape(-1, width)


def fit(docs: DataFrame, labels: DataFrame, column: str, allowed, sample: int = SAMPLE):
    """(word vectors, network) from all texts of ``docs`` and a bounded sample
    of the rows of ``labels`` that ``allowed`` admits."""
    vectors = word_vectors(docs)
    wanted = bounded_sample(labels, column, allowed, sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM floats
    chosen = np.array(sorted(wanted), dtype=np.int64)           # ``sample`` ids

    def training(batches):
        for batch in batches:
            keep = pa.array(np.isin(batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), chosen)
                            & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
            part = batch.filter(keep)
            if part.num_rows:
                x = pool(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])

    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(training, "doc_id long, x array<float>").groupBy("doc_id").agg(F.max("x").alias("x")).orderBy("doc_id").toArrow())
    y = np.array([wanted[d] for d in rows.column("doc_id").to_pylist()], dtype=np.int64)
    return shared, Network(vectors_of(rows.column("x"), POOLED), y)


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``score``, every text scored whole."""
    prepare(docs.sparkSession)
    vectors, network = model

    def run(batches):
        for batch in batches:
            s = network.score(pool(batch.column(batch.num_columns - 1), vectors.value)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*keep, "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("__scored"))
    return rows.mapInArrow(run, rows.drop("__scored").schema.add("score", "double"))


def keep_good(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``."""
    prepare(docs.sparkSession)
    vectors, network = model
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(network.score(pool(batch.column(at), vectors.value)) >= threshold, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over all ``documents``, fitted on ``labels.quality`` of rows
    whose fold (crc32 of doc_id modulo 5) is not 0."""
    from crawlscope.sources.tables import load

    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
