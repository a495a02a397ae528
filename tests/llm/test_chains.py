"""Operator 1 on long chains of near copies, against brute force."""

import random

import numpy as np

from crawlscope.llm import lines

from .common import frame
from .test_joins import changed, closure, edit_distance


def drift(rng, base, versions):
    """Versions of a line, each two replaced characters from the one before."""
    out = [base]
    for _ in range(versions - 1):
        x = list(out[-1])
        for k in rng.sample(range(len(x)), 2):
            x[k] = rng.choice("abcdefgh")
        out.append("".join(x))
    return out


def classes(texts):
    """Label of each line by all pairs."""
    size = np.array([len(x) for x in texts])
    pairs = [(i, j) for i in range(len(texts)) for j in np.flatnonzero(abs(size[:i] - size[i]) <= lines.EDITS).tolist()]
    apart = lines.banded_distance([texts[i] for i, _ in pairs], [texts[j] for _, j in pairs])
    return closure(len(texts), [p for p, d in zip(pairs, apart) if d <= lines.EDITS])


def check(spark, texts):
    texts = list(dict.fromkeys(texts))
    docs = [texts[i:i + 10] for i in range(0, len(texts), 10)]
    label = classes(texts)
    got = {r.doc_id * 10 + r.line: r.first_doc * 10 + r.first_line
           for r in lines.line_classes(frame(spark, [(i, "\n".join(x)) for i, x in enumerate(docs)])).collect()}
    assert got == dict(enumerate(label))
    return label


def test_chains_of_versions_stay_whole(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        texts += drift(rng, "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30, 90))), 40)
    rng.shuffle(texts)
    label = check(spark, texts)
    assert max(label.count(x) for x in set(label)) >= 40


def test_lines_that_differ_in_a_long_number(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        number = [rng.choice("0123456789") for _ in range(12)]
        for _ in range(25):
            for k in rng.sample(range(12), 2):
                number[k] = rng.choice("0123456789")
            texts.append(f"entry {''.join(number)} of the daily register")
    rng.shuffle(texts)
    label = check(spark, texts)
    assert len(set(label)) > 1


def test_bounds_hold_the_distance():
    rng = random.Random(13)
    first = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    second = [changed(rng, a, rng.randrange(80)) for a in first]
    near, far = lines.distance_bounds(first, second)
    d = np.array([edit_distance(a, b) for a, b in zip(first, second)])
    assert (near <= d).all() and (d <= far).all()
    assert (near == far)[d <= lines.WIDE].all() and (near > lines.WIDE)[d > lines.WIDE].all()
    assert ((d > lines.BAND) & (d <= lines.WIDE)).any() and (d > lines.WIDE).any()
