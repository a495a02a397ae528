"""Operators 2 and 9: held-out accuracy and defined cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import quality, toxicity
from crawlscope.llm.labelled import bounded_sample, fold

from .common import ODD, frame

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
@pytest.mark.parametrize("query,column", [(quality.op2_quality_classifier, "quality"), (toxicity.op9_toxicity, "toxic")])
def test_held_out_accuracy(spark, query, column):
    got = query(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert len(held) > 40
    assert (held.predicted == (held[column] > 0)).mean() >= 0.88


SF_LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF_LARGER), reason="driver test data not present")
def test_held_out_recall_of_toxic_documents(spark):
    held = toxicity.op9_toxicity(spark, SF_LARGER).where("held_out").join(spark.read.parquet(f"{SF_LARGER}/labels.parquet"), "doc_id").toPandas()
    toxic = held.toxic == 1
    rank = held.score.rank()
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert held.predicted[toxic].mean() >= 0.9 and held.predicted[~toxic].mean() <= 0.03 and area >= 0.95


def test_folds_use_the_decimal_id(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_sample_is_bounded_and_merges_repeats(spark):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = labels.unionByName(labels.limit(10)).unionByName(spark.sql("select null doc_id, 1 quality"))
    got = bounded_sample(labels, "quality", F.lit(True), 500)
    assert 300 < len(got) <= 625 and all(y == d % 2 for d, y in got.items())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_texts_and_missing_labels(spark, module):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "no id")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i in range(len(ODD))] + [(None, 1, 1), (2, None, None)],
                                   "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = module.score(docs, module.fit(docs, given, "quality", F.lit(True)), ["doc_id"]).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert module.score(empty, module.fit(empty, labels, "quality", F.lit(True)), ["doc_id"]).count() == 0


def test_network_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(2000) < 0.1)).astype(int)
    p = quality.Network(x[:1500], y[:1500]).score(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.8
    assert abs(p[p > 0.7].mean() - y[1500:][p > 0.7].mean()) < 0.1


def test_label_model_finds_accuracies_and_joins_copies():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.3
    accurate = [y & (rng.random(20000) < a) | ~y & (rng.random(20000) < 0.02) for a in (0.8, 0.7, 0.6)]
    copy = accurate[0] ^ (rng.random(20000) < 0.01)  # repeats the first voter
    votes = np.stack([*accurate, copy], 1)
    pattern, back, n = np.unique(votes @ (1 << np.arange(4)), return_inverse=True, return_counts=True)
    known = rng.random(20000) < 0.05  # a few labelled rows
    yes, of = np.bincount(back, y & known, len(pattern)), np.bincount(back, known, len(pattern))
    start = (yes + 0.6) / (of + 2)
    model = toxicity.LabelModel(pattern, n, 4, start)
    assert [0, 3] in model.factors
    assert ((model.posterior[back] > 0.5) == y).mean() > 0.92


def test_training_rows_come_from_buffers():
    """The driver takes the pooled texts without a Python number for each entry."""
    import tracemalloc

    import pyarrow as pa

    from crawlscope.llm.quality import vectors_of

    x = np.random.default_rng(1).normal(size=(3000, 48)).astype(np.float32)
    whole = pa.array(list(x), pa.list_(pa.float32()))
    column = pa.chunked_array([whole[:7], whole[7:7], whole[7:2000], whole[2000:]])
    tracemalloc.start()
    found = vectors_of(column, 48)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.dtype == np.float64 and (found == x).all()
    assert peak < 2 * found.nbytes
    assert vectors_of(pa.chunked_array([], pa.list_(pa.float32())), 48).shape == (0, 48)


class _Driver:
    """A session whose driver has a heap of 900; ``after``: what is left of it
    once its garbage is collected."""

    def __init__(self, after):
        self.now, self.after, self.collected, self.applicationId = 200, after, 0, "driver of a test"
        self.sparkContext = self._jvm = self.java = self.lang = self.Runtime = self

    def getRuntime(self):
        return self

    def totalMemory(self):
        return self.now

    def maxMemory(self):
        return 900

    def gc(self):
        self.now, self.collected = self.after, self.collected + 1


def test_drivers_heap_is_collected_where_it_has_grown(monkeypatch):
    from crawlscope.llm import store

    monkeypatch.setattr(store, "_settled", {})
    driver = _Driver(320)
    for now, collected in ((200, 0), (299, 0), (310, 1), (320, 1), (350, 1), (370, 2), (900, 3), (330, 3)):
        driver.now = now
        store.release(driver)
        assert driver.collected == collected


def test_every_save_releases_what_the_driver_holds(spark, monkeypatch):
    from crawlscope.llm import store

    seen = []
    monkeypatch.setattr(store, "release", seen.append)
    assert store.save(spark.range(3)).count() == 3
    assert seen == [spark]
