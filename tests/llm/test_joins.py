"""Operators 1, 5 and 7 against brute force, with every defined case."""

import hashlib
import random
import re

import numpy as np
import pytest

from crawlscope.llm import jaccard, lines, suffix

from .common import corpus, frame


def closure(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, what = rng.randrange(len(out) + 1), rng.randrange(3)
        if what == 0:
            out.insert(k, rng.choice("abcé"))
        elif k < len(out):
            out[k:k + 1] = [] if what == 1 else [rng.choice("abcé")]
    return "".join(out)


def test_banded_distance_is_exact_up_to_its_band():
    rng = random.Random(2)
    first = ["".join(rng.choice("abcé") for _ in range(rng.randrange(60))) for _ in range(600)]
    second = [changed(rng, a, rng.randrange(14)) for a in first]
    want = [min(edit_distance(a, b), lines.BAND + 1) for a, b in zip(first, second)]
    assert lines.banded_distance(first, second).tolist() == want


def test_lines_match_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(22, 60))) for _ in range(12)]
    rows = corpus(2, 2, 4) + [(1000 + i, "\n".join(changed(rng, rng.choice(base), rng.randrange(3)) for _ in range(5))) for i in range(40)]
    rows += [(None, rows[-1][1]), rows[-1]]
    seen = {}
    for d, t in rows:
        if d is not None and t is not None:
            for k, x in enumerate(t.split("\n")):
                if len(x) >= lines.LEAST:
                    seen.setdefault(x, set()).add((d, k))
    texts = sorted(seen, key=lambda x: min(seen[x]))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if abs(len(texts[i]) - len(texts[j])) <= 2]
    apart = lines.banded_distance([texts[i] for i, _ in pairs], [texts[j] for _, j in pairs])
    links = [p for p, d in zip(pairs, apart) if d <= 2]
    label = closure(len(texts), links)
    want = {at: min(min(seen[texts[j]]) for j in range(len(texts)) if label[j] == label[i]) for i, x in enumerate(texts) for at in seen[x]}
    docs = frame(spark, rows)
    got = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in lines.line_classes(docs).collect()}
    assert got == want
    assert any(a != b for a, b in want.items())
    left = lines.deduplicate(docs).collect()
    assert len(left) == len(rows)
    by_id = {r.doc_id: r for r in left}
    for d, t in rows:
        if d is None:
            assert by_id[None].text == t and by_id[None].removed is None
        elif t is None:
            assert by_id[d].text is None
        else:
            keep = [x for k, x in enumerate(t.split("\n")) if want.get((d, k), (d, k)) == (d, k)]
            assert by_id[d].text == "\n".join(keep)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard_matches_brute_force(spark, size, percent):
    rows = corpus(3)
    rows += [(9000, rows[20][1]), (9000, rows[20][1]), (None, rows[20][1])]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    label = closure(len(rows), links)
    lowest = {}
    for (d, _), c in zip(rows, label):
        lowest[c] = min(d if d is not None else 1 << 60, lowest.get(c, 1 << 60))
    want = sorted((-1 if d is None else d, len(s), lowest[c] if s else d) for (d, _), s, c in zip(rows, sets, label))
    got = jaccard.near_duplicates(frame(spark, rows), size, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert len(links) > 20
    kept = [r.doc_id for r in jaccard.keep_first(frame(spark, rows), size, percent).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({d for d, _, c in want if d == c and d >= 0})


def test_components_need_no_pair_lists(spark):
    """A chain, a clique and near misses around common keys: the components of
    the full join, on a line as the metric space."""
    from pyspark.sql import functions as F

    from crawlscope.llm import linkage

    at = {i: p for i, p in enumerate([0, 1, 2, 3, 4, 10, 11, 12, 30, 31, 50, 70, 71, 73, 76])}
    keys = spark.createDataFrame([(k, i) for i in at for k in (1, 2 + at[i] // 20)], "key long, id long")
    place = F.create_map(*[F.lit(x) for kv in at.items() for x in kv])

    def distance(pairs):
        return pairs.select("a", "b", F.abs(place[F.col("a")] - place[F.col("b")]).cast("long").alias("far"))

    def compare(pairs):
        return distance(pairs).select("a", "b", F.col("far").alias("low"), (F.col("far") <= 2).alias("linked"))
    shared = linkage.shared_keys(keys)
    got = {r.id: r.comp for r in linkage.components_of_shared(shared, compare, distance, lambda ids: ids.withColumn("reach", F.lit(2).cast("long"))).collect()}
    label = closure(len(at), [(a, b) for a in at for b in at if a > b and abs(at[a] - at[b]) <= 2])
    assert {i: got.get(i, i) for i in at} == dict(enumerate(label))


def brute_repeats(rows):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i:i + 50], d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        hit = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 49):
            if d is not None and first[raw[i:i + 50]] < d:
                hit[i:i + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~hit])
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((-1 if d is None else d, len(raw), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_merged_transforms_find_repeated_windows():
    rng = random.Random(7)
    base = [bytes(rng.choice(b"ab\x00") for _ in range(120)) for _ in range(3)]
    strings, docs = [], []
    for _ in range(80):
        k = rng.randrange(40)
        s = bytearray(rng.choice(base)[k:k + rng.randrange(50, 80)])
        if rng.random() < 0.5:
            s[rng.randrange(len(s))] = 99
        strings.append(bytes(s))
        docs.append(rng.randrange(50))
    least = {}
    for s, d in zip(strings, docs):
        for i in range(len(s) - 49):
            least[s[i:i + 50]] = min(d, least.get(s[i:i + 50], d))
    want = [[least[s[i:i + 50]] for i in range(len(s) - 49)] for s in strings]
    size, suffix.SHARD = suffix.SHARD, 300
    try:
        assert [w.tolist() for w in suffix.first_documents(strings, np.array(docs))] == want
    finally:
        suffix.SHARD = size


def test_merge_derives_common_prefixes():
    strings = [b"banana", b"bandana", b"anagram", b"nab"]
    parts = [suffix.transform(strings[:2]), suffix.transform(strings[2:])]
    source, prefix = suffix.merge([p[0] for p in parts], 20)
    at = np.argsort(source, kind="stable")
    place = np.empty((len(source), 2), dtype=int)
    place[at] = np.concatenate([np.stack([p[1] + b, p[2]], 1) for p, b in zip(parts, (0, 2))])
    text = [(strings[s] + b"\x00" + strings[s] * 5)[o:o + 20] if o <= len(strings[s]) else b"" for s, o in place]
    rotations = [((strings[s] + b"\x00") * 9)[o:o + 20] for s, o in place]
    assert rotations == sorted(rotations) and len(text) == sum(len(s) + 1 for s in strings)
    for i in range(1, len(rotations)):
        same = next((k for k in range(20) if rotations[i][k] != rotations[i - 1][k]), 20)
        assert prefix[i] == same


@pytest.mark.parametrize("crowded", [suffix.CROWDED, 1])
def test_repeats_match_brute_force(spark, crowded, monkeypatch):
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    rows = corpus(4, 3, 5)
    rows += [rows[-1], (None, rows[-1][1]), (7777, "q" * 300), (7778, "q" * 120), (7779, rows[-1][1][:49])]
    docs = frame(spark, rows)
    ranges = suffix.repeated_ranges(docs)
    got = {r.doc_id: r for r in suffix._cut_documents(docs, ranges).collect()}
    want = brute_repeats(rows)
    assert sum(w[2] for w in want) > 1000
    for d, n, removed, spans, kept in want:
        if removed:
            r = got[d]
            assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == (n, removed, spans, kept)
        else:
            assert d not in got


def test_empty_tables(spark):
    docs = frame(spark, []).limit(0)
    assert jaccard.near_duplicates(docs).count() == 0
    assert lines.deduplicate(docs).count() == 0
    assert suffix.remove_repeats(docs).count() == 0


def _edited_copies(rng, base, n, most):
    """Copies of a word list, each with up to ``most`` words of its own, every
    third one a copy of an earlier copy with one word changed."""
    out = [list(base)]
    for k in range(n):
        text = list(out[rng.integers(len(out))]) if k % 3 == 0 else list(base)
        for _ in range(1 if k % 3 == 0 else rng.integers(1, most + 1)):
            at = rng.integers(len(text))
            text[at:at + rng.integers(0, 2)] = ["".join(rng.choice(list("abcdefgh"), 5))] * int(rng.integers(0, 2))
        out.append(text)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("hot", [2, 64])
def test_group_of_far_copies_loses_no_link(spark, monkeypatch, hot):
    from crawlscope.llm import linkage

    monkeypatch.setattr(linkage, "HOT", hot)
    rng = np.random.default_rng(11)
    texts = _edited_copies(rng, ["".join(rng.choice(list("ijklmnop"), 5)) for _ in range(60)], 90, 14)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [t.split() for t in texts]
    sets = [{tuple(w[i:i + 4]) for i in range(len(w) - 3)} for w in words]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    want = closure(len(texts), [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(want))

    lines_ = [t[:40] + t[k % 3 + 40:] for k, t in enumerate(texts)] + [t[:90] + "z" + t[91:] for t in texts[::4]]
    docs = spark.createDataFrame(list(enumerate(lines_)), "doc_id long, text string")
    pairs = [(a, b) for b in range(len(lines_)) for a in range(b)]
    far = lines.banded_distance([lines_[a] for a, _ in pairs], [lines_[b] for _, b in pairs])
    want = closure(len(lines_), [p for p, d in zip(pairs, far) if d <= 2])
    assert {r.doc_id: r.first_doc for r in lines.line_classes(docs).collect()} == dict(enumerate(want))


def test_pairs_of_a_group_of_far_copies_stay_few(spark, monkeypatch):
    """Copies that are linked with no other one are not compared two by two."""
    made = {}
    for kind, op in (("op7", jaccard.Sets), ("op1", lines.Lines)):
        def counted(self, pairs, kind=kind, plain=op.compare):
            pairs = pairs.localCheckpoint()
            made[kind] = made.get(kind, 0) + pairs.count()
            return plain(self, pairs)
        monkeypatch.setattr(op, "compare", counted)
    rng = np.random.default_rng(5)
    base, n = ["".join(rng.choice(list("ijklmnop"), 5)) for _ in range(80)], 300
    texts = []
    for _ in range(n):
        text = list(base)
        for at in rng.choice(80, 8, replace=False):
            text[at] = "".join(rng.choice(list("abcdefgh"), 6))
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert jaccard.near_duplicates(docs).where("component_id = doc_id").count() == n
    assert lines.line_classes(docs).where("first_doc = doc_id").count() == n
    assert max(made.values()) < n * n / 20, made


def test_save_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from crawlscope.llm.store import save

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}
    before = shuffled()
    out = save(spark.range(5000).repartition(4, "id").groupBy((F.col("id") % 50).alias("k")).count())
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.25)
    assert not shuffled() - before and out.count() == 50


def test_a_cluster_and_its_far_neighbours_are_not_compared_member_by_member(spark, monkeypatch):
    """A few far copies meet a cluster in a few keys only; the members that
    reach out of the cluster are not all compared with them."""
    made = []

    def counted(self, pairs, plain=jaccard.Sets.compare):
        pairs = pairs.localCheckpoint()
        made.append(pairs.count())
        return plain(self, pairs)
    monkeypatch.setattr(jaccard.Sets, "compare", counted)
    rng = np.random.default_rng(8)
    base, texts = ["".join(rng.choice(list("ijklmnop"), 5)) for _ in range(80)], []
    for k in range(172):
        text = list(base)
        for at in rng.choice(80, 0 if k == 0 else 1 if k < 160 else 3, replace=False):
            text[at] = "".join(rng.choice(list("abcdefgh"), 6))
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i:i + 4]) for i in range(77)} for t in texts]
    want = closure(172, [(a, b) for b in range(172) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == dict(enumerate(want))
    assert sum(made) < 4 * 172, made


def test_ranges_of_many_runs_are_found_at_once(monkeypatch):
    """Whatever the batches and the slices that are merged at once, and not run by run."""
    import pyarrow as pa

    rng = random.Random(9)
    base = ["".join(rng.choice("abcd") for _ in range(150)) for _ in range(4)]
    rows = []
    for d in range(60):
        text = rng.choice(base)[rng.randrange(40):] + str(d)
        at = rng.randrange(len(text))
        rows.append((d, text[:at] + "-" * (d % 3) + text[at:]))
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), pa.array([d for d, _ in rows]), pa.array(np.zeros(60, np.int32))], names=["text", "doc_id", "mark"])
    found = pa.Table.from_batches(list(suffix._runs_of(batch, lambda _, h: np.ones(len(h), dtype=bool)))).sort_by("key")
    calls = []
    monkeypatch.setattr(suffix, "covered", lambda *a, plain=suffix.covered: calls.append(1) or plain(*a))
    want = {d: (removed, spans, kept) for d, _, removed, spans, kept in brute_repeats(rows)}
    for merged, step in ((suffix.MERGED, 1000), (300, 7)):
        monkeypatch.setattr(suffix, "MERGED", merged)
        out = pa.Table.from_batches(list(suffix._merge_task(iter(found.to_batches(max_chunksize=step)))))
        ranges = {}
        for r in out.to_pylist():
            ranges.setdefault(r["doc_id"], []).append({"a": r["a"], "b": r["b"]})
        texts = pa.RecordBatch.from_arrays(
            [pa.array(list(ranges)), pa.array([len(rows[d][1]) for d in ranges]), pa.array([rows[d][1] for d in ranges]),
             pa.array(list(ranges.values()), pa.list_(pa.struct({"a": pa.int64(), "b": pa.int64()})))], names=["doc_id", "size", "text", "ranges"])
        got = {r["doc_id"]: (r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for b in suffix._apply([texts]) for r in b.to_pylist()}
        assert got == {d: w for d, w in want.items() if w[0]} and len(got) > 30
        if step == 1000:
            assert len(calls) < 5


def test_near_members_meet_by_what_they_share(spark, monkeypatch):
    """Lines that are near one line in substrings, but no two of them linked,
    are not compared two by two; those that are linked are found."""
    made = []

    def counted(self, pairs, plain=lines.Lines.compare):
        pairs = pairs.localCheckpoint()
        made.append(pairs.count())
        return plain(self, pairs)
    monkeypatch.setattr(lines.Lines, "compare", counted)
    rng = np.random.default_rng(21)
    base = "".join(rng.choice(list("abcdefghijklmnop"), 240))
    texts = [base]
    for k in range(240):
        at = int(rng.integers(237))
        text = base[:at] + "".join(rng.choice(list("qrstuvwxyz"), 4)) + base[at + 4:]
        texts.append(text)
        if k % 40 == 0:  # one edit more
            texts.append(text[:at + 2] + "0" + text[at + 3:])
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    near = lines.banded_distance([texts[a] for a, _ in pairs], [texts[b] for _, b in pairs]) <= lines.EDITS
    want = closure(len(texts), [p for p, n in zip(pairs, near) if n])
    assert 230 < len(set(want)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.first_doc for r in lines.line_classes(docs).collect()} == dict(enumerate(want))
    assert sum(made) < len(texts) ** 2 / 20, made


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_as_many_keys_as_said(percent):
    rng = np.random.default_rng(31)
    seen = set()
    for _ in range(400):
        n = int(rng.integers(8, 900))
        pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
        m = int(rng.integers(n, n * 100 // percent + 1))
        most = (100 - percent) * (n + m) // (100 + percent)
        taken = int(rng.integers(0, (most - (m - n)) // 2 + 1)) if most >= m - n else 0
        a, b = np.unique(pool[:n]), np.unique(pool[taken:taken + m])
        if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)) or len(np.setxor1d(a, b)) == 0:
            continue
        shared = len(set(np.concatenate(jaccard.block_keys(a, percent)).tolist()) & set(np.concatenate(jaccard.block_keys(b, percent)).tolist()))
        least = max(jaccard.least_agreements(len(s), percent) for s in (a, b))
        assert shared >= least >= 2
        seen.add(least)
    assert max(seen) > 5


def test_ids_with_too_few_keys_leave(spark):
    from crawlscope.llm import linkage

    rows = [(1, 10, 10), (1, 11, 11), (2, 10, 10), (2, 11, 11), (2, 12, 12), (3, 12, 12), (3, 13, 13), (4, 14, 14), (4, 15, 15), (5, 14, 14)]
    rows = spark.createDataFrame(rows, "key long, id long, comp long")
    left = linkage._agreeing(rows, lambda ids: ids.selectExpr("id", "2L as agree"))
    assert sorted((r.key, r.id) for r in left.collect()) == [(1, 10), (1, 11), (2, 10), (2, 11)]
