"""Operator 12 against removal in every order, document by document."""

import random
import re
from itertools import permutations

from crawlscope.llm import filteraudit

from .common import ODD, words

DOCS = "doc_id long, text string, lang string, source string, n int, mask string, words string"
LABELS = "doc_id long, quality int, toxic int, extra string"


def table(seed=3):
    rng = random.Random(seed)
    texts = list(ODD) + ["", "", "AB CD " * 30, "a# b"] + [words(rng, rng.randrange(30, 80), 60) + rng.choice(["", " $", " UPPER CASE WORDS"]) for _ in range(60)]
    texts += [rng.choice(texts) for _ in range(60)]
    rows = [(i if rng.random() < 0.95 else rng.randrange(40), t, "en", rng.choice(["a", "b", "c", None, ""]), 1, "m", "w") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[-1], "en", "a", 1, "m", "w"), (None, texts[-1], "en", "a", 1, "m", "w")]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 120, 2)] + [(4, 1, 1, "x"), (None, 1, 1, "x")]
    return rows, labels


def brute(rows, labels):
    marks = {}
    for d, q, t, _ in labels:
        if d is not None:
            old = marks.get(d, (0, 0))
            marks[d] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    docs = []
    for d, t, _, source, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and d > first[t] else set()
        docs.append((source or "", fails, *marks.get(d, (0, 0))))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            everything = left
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in everything)
                out[part, "".join(order), k + 1] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in everything),
                                                    sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_matches_removal_in_every_order(spark, tmp_path):
    rows, labels = table()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    out = filteraudit.op12_filter_interaction_audit(spark, str(tmp_path))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in out.collect()}
    assert got == brute(rows, labels) and len(got) == 4 * 600


def test_shares_add_up_to_what_all_filters_remove(spark):
    rows, labels = table(4)
    audit = filteraudit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).where("filter_order = 'ABCDE'")
    for part in {r.part for r in audit.select("part").collect()}:
        steps = audit.where(audit.part == part).collect()
        assert sum(r.shapley for r in steps) == 120 * sum(r.removed for r in steps)


def test_other_filters_and_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b", "s"), (2, "b", "s"), (3, "", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], LABELS)
    out = filteraudit.audit(docs, labels, {"x": F.col("text").contains("a"), "y": F.col("text").contains("b")}).collect()
    assert {(r.filter_order, r.step): (r.removed, r.shapley) for r in out} == {("xy", 1): (1, 1), ("xy", 2): (1, 3), ("yx", 1): (2, 3), ("yx", 2): (0, 1)}
    assert filteraudit.audit(docs.limit(0), labels).count() == 0
