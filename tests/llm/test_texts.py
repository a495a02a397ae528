"""Operators 3, 4, 6, 8 and 10: round trips, brute force, defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlscope.llm import chat, decontaminate, packing, topk, urlfilter

from .common import ODD, corpus, frame, words


def test_reply_tree_takes_the_best_branch(spark):
    rows = [("t", 1, None, "user", "root", 1.0), ("t", 2, 1, "assistant", "a", 5.0), ("t", 3, 1, "assistant", "b", 1.0),
            ("t", 4, 2, "user", "deep", 0.0), ("t", 5, 4, "assistant", "end", 9.0), ("t", 6, 3, "user", "x", 2.0),
            ("t", 6, 3, "user", "x", 2.0), ("u", 1, 99, None, None, None), (None, 1, None, "user", "null tree", 0.0), ("null", 1, None, "user", "a name", 0.0),
            ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "cycle", 0.0)]
    messages = spark.createDataFrame(rows, "tree_id string, msg_id long, parent_id long, role string, text string, score double")
    got = {r.tree_id: r for r in chat.format_paths(messages).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got["t"].turns] == [("user", "root"), ("assistant", "a"), ("user", "deep"), ("assistant", "end")]
    assert got["t"].leaf == 5 and set(got) == {"t", "u", None, "null"}
    assert got[None].turns[0].text == "null tree" and got["null"].turns[0].text == "a name"
    assert [(t.role, t.text) for t in got["u"].turns] == [("", "")]
    both = chat.format_paths(messages, top=2).where("tree_id = 't'").count()
    assert both == 2


def test_long_chain_and_escapes_round_trip(spark):
    rng = random.Random(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>\n", "\\", "<\\|im_end|>", "<", "[", "\n", "plain é 😀", "<<SYS>>", "<\\\\/s>"]
    turns = [(7, i, rng.choice(["user", "assistant", "odd\nrole\\n", "<|im_end|>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for i in range(70)]
    turns += [(8, i, "assistant", t) for i, t in enumerate(ODD)] + [(None, 1, "user", "x"), (9, 1, "user", "same"), (9, 1, "user", "same")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.tree_id: r for r in chat.format_paths(chat.linear(rows)).withColumn("turns", chat.read_back(F.col("formatted")))
           .withColumn("learned", F.transform("loss", lambda s: chat.unescape(F.substr("formatted", s["start"], s["size"])))).collect()}
    for conv in (7, 8, 9):
        want = [(r, t or "") for c, _, r, t in turns if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].learned == [t for r, t in want if r == "assistant"]
    assert got[None].turns[0].text == "x"
    assert chat.format_paths(chat.linear(rows.limit(0))).count() == 0


def test_chat_stays_native(spark):
    rows = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_paths(chat.linear(rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_decontaminate(rows, items, size=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for item, t in items:
        w = cut(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = [(i, words(rng, n, 50)) for i, n in enumerate((3, 9, 10, 11, 40, 5, 25))] + [(3, words(rng, 11, 50)), (50, ""), (51, None), (None, words(rng, 12, 50))]
    rows = corpus(5, 1, 3)
    for i in range(25):
        item = rng.choice([t for _, t in items if t])
        rows.append((5000 + i, words(rng, 30, 50) + "! " + item.upper() + ", " + words(rng, 10, 50) + item[len(item) // 2:]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0], *r[1:])
    want = sorted(brute_decontaminate(rows, items), key=key)
    docs = frame(spark, rows)
    got = decontaminate.report(docs, benchmark)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    blocks = decontaminate.benchmark_hits(docs, benchmark, max_windows=20)  # several blocks
    assert sorted((r.doc_id, len(r.spans), ",".join(r["items"])) for r in blocks.collect()) == sorted(
        (r.doc_id, len(r.spans), ",".join(r["items"])) for r in decontaminate.benchmark_hits(docs, benchmark).collect())
    dirty = {w[0] for w in want if w[5]}
    assert dirty and {r.doc_id for r in decontaminate.remove(docs, benchmark).collect()} == {d for d, _ in rows} - dirty
    cut = decontaminate.remove(docs, benchmark, whole=False)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    same = {d: t for d, t in rows}
    for r in cut.collect():
        if r.doc_id not in dirty:
            assert r.text == same[r.doc_id]
    assert decontaminate.report(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), benchmark).count() == 0


def test_url_rules_match_brute_force(spark):
    rng = random.Random(5)
    hosts = ["org", "example.org", "a.example.org", "EXAMPLE.org", "xample.org", "com", "b.com", "", "org.", "é.com", "a..com"]
    paths = ["", "/", "/es/", "/es/1", "/en/1", "/en/12", "/fr/x", "/de/", "/ES/", "/\x01\x7f"]
    urls = [f"http{rng.choice('s ')}://{h}{p}{rng.choice(['', '?q=/es/', '#x', '?://'])}" for h in hosts for p in paths]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "x\n://org/y\nz"]
    rules = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False),
             ("com", "", False), ("com", "", True), (None, "/", True), ("", "/", True), ("a.example.org", None, True)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, allow boolean")
    known = {}
    for h, p, a in rules:
        if h:
            known[h, p or ""] = known.get((h, p or ""), True) and a

    def verdict(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, a) for (h, p), a in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], ("allow" if best[3] else "block") if best else "block"
    want = sorted(((i, *verdict(u)) for i, u in [*enumerate(urls), (0, urls[0])]), key=repr)
    for parts in (1, 7):
        got = urlfilter.judge(pages, table, default="block", parts=parts).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert urlfilter.judge(pages.limit(0), table).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, table.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("block", [topk.BLOCK, 7])
def test_topk_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", max(2, block // 2))
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centre[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(180)]
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7),
                                                          (304, []), (310, [0.5, -0.25]), (10, rows[10][1]), (None, rows[0][1])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    exact = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            full = np.zeros(8, dtype=np.int64)
            full[:len(v)] = np.floor(256 * np.array(v, dtype=np.float32).astype(float))
            exact[i] = full
    want = []
    for q in exact:
        if q % 10 == 0:
            best = sorted((-int(exact[q] @ x), i) for i, x in exact.items() if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = topk.search(vectors, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(vectors.limit(0), F.lit(True)).count() == 0
    assert topk.search(vectors, F.lit(False)).count() == 0


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(packing.default_vocabulary())
    texts = [t or "" for t in ODD] + [t or "" for _, t in corpus(6)] + [
        "don't we'll I'd ΑΣ. x² 3.14, İstanbul <|endoftext|> ., a., !!, Ⅷ ﬁn Ǆ e\u0301 \u0301x", "Ünder, Über. A.B. ''s l'été"]
    raw = e.encode(texts) + e.encode(texts[::-1])[::-1]
    for t, r in zip(texts + texts, raw):
        assert np.frombuffer(r, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_places_every_token_once(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, words(random.Random(i), 5 + i * 7 % 300)) for i in range(80)] + [(100, "again"), (None, "no id")]
    docs = frame(spark, rows)
    made = packing.pieces(docs, packing.default_vocabulary(), 256, with_ids=True).collect()
    e = packing.Encoder(packing.default_vocabulary())
    want = []
    for d, t in rows:
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[a:a + 256], "<u4").tobytes()
            want.append((-1 if d is None else d, k, a, len(part) // 4, zlib.crc32(part), part))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in made) == sorted(want)
    placed = packing.pack(packing.pieces(docs, packing.default_vocabulary(), 256), 256).toPandas().sort_values(["sequence_id", "offset"])
    assert len(placed) == len(want)
    by = placed.groupby("sequence_id")["length"]
    assert (by.cumsum() - placed["length"] == placed["offset"]).all() and by.sum().max() <= 256
    assert placed.sequence_id.nunique() <= 1.1 * placed["length"].sum() / 256 + 2
    assert packing.pack(packing.pieces(docs.limit(0), packing.default_vocabulary())).count() == 0


def test_sum_of_squares_takes_the_smallest_change():
    rng = np.random.default_rng(2)
    sizes, capacity = rng.integers(1, 21, 300), 20
    sequence, offset = packing.sum_of_squares(sizes, capacity)
    fill = {}
    for s, b, o in zip(sizes.tolist(), sequence.tolist(), offset.tolist()):
        def squares(state):
            gaps = [capacity - f for f in state.values() if f < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        choices = [squares({**fill, c: f + s}) for c, f in fill.items() if f + s <= capacity] + [squares({**fill, "new": s})]
        assert o == fill.get(b, 0) and o + s <= capacity
        fill[b] = o + s
        assert squares(fill) == min(choices)


@pytest.mark.parametrize("blocks", [3, 14, 2_000_000])
def test_cuts_do_not_depend_on_blocks(spark, blocks):
    """Two items overlap: what one of them hits stays hit when the other's
    words are gone."""
    items = [(1, "a b c d e f g h i j"), (2, "f g h i j k l m n o"), (3, "q r s t u v w x y z")]
    rows = [(1, "zz a b c d e f g h i j k l m n o p yy"), (2, "clean"), (3, None), (4, "Q r, s t u v w x y z!"), (None, "a b c d e f g h i j")]
    docs = spark.createDataFrame([(*r, "s", [7]) for r in rows], "doc_id long, text string, source string, spans array<int>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.remove(docs, bench, whole=False, max_windows=blocks).collect()
    assert {r.doc_id: r.text for r in got} == {1: "zz  p yy", 2: "clean", 3: None, 4: "!", None: ""}
    assert all(r.spans == [7] and r.source == "s" for r in got)
    left = decontaminate.remove(docs, bench, max_windows=blocks)
    assert {r.doc_id for r in left.collect()} == {2, 3} and left.schema == docs.schema
