"""Operators 1 and 7 where rows share a doc_id or have none and texts differ."""

import random

from crawlscope.llm import jaccard, lines

from .common import frame, words


def varied(text, at):
    """``text`` with four words replaced."""
    w = text.split()
    return " ".join(w[:at] + [f"v{at}x{k}" for k in range(4)] + w[at + 4:])


def test_jaccard_keeps_the_texts_of_one_id_apart(spark):
    rng = random.Random(21)
    base = [words(rng, 100, 5000) for _ in range(24)]
    rows = []
    for i in range(12):  # each id has two unlinked texts, each with a near copy under a later pair of ids
        rows += [(i, base[2 * i]), (i, base[2 * i + 1])]
        rows += [(100 + i, varied(base[2 * i], 40)), (100 + (i + 1) % 12, varied(base[2 * i + 1], 40))]
    bridged = words(rng, 100, 5000)
    middle = varied(bridged, 40)
    rows += [(500, bridged), (None, middle), (501, varied(middle, 70)), (600, ""), (600, words(rng, 50, 5000))]
    want = [(i, i) for i in range(12) for _ in range(2)] + [(100 + i, i) for i in range(12)] + [(100 + (i + 1) % 12, i) for i in range(12)]
    want += [(500, 500), (-1, 500), (501, 500), (600, 600), (600, 600)]
    docs = frame(spark, rows).repartition(4)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == sorted(want)
    kept = {(r.doc_id, r.text) for r in jaccard.keep_first(docs).collect()}
    assert kept == {(d, t) for d, t in rows if d is None or d < 100 or d in (500, 600)}


def test_lines_are_cut_from_their_own_text(spark):
    own = [f"line {k} that only one of the texts holds {k * 7919}{k * 104729}" for k in range(1, 5)]
    common = "a line that several of the documents have"
    rows = [(1, common), (2, f"{own[0]}\n{common}"), (2, f"{common}\n{own[1]}"), (3, f"{own[2]}\n{own[3]}")]
    left = {(r.doc_id, r.text) for r in lines.deduplicate(frame(spark, rows)).collect()}
    assert left == {(1, common), (2, own[0]), (2, own[1]), (3, f"{own[2]}\n{own[3]}")}
