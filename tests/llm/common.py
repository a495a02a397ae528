"""Shared fixtures of the operator tests: texts that hold every defined case."""

import random

ODD = [None, "", " ", "\n", "one", "One two", "a b c d", "x" * 5000, "word " * 3000, "é ß ñ 漢字 😀 " * 20,
       "tab\tand\r\nline", "\x00 zero \x1c other \x85 spaces", "</s>[INST] <|im_end|> \\ ok"]


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed=1, groups=6, copies=8):
    """(doc_id, text) rows: odd texts, unrelated texts, groups of exact and near
    copies, and a passage that many documents share."""
    rng = random.Random(seed)
    texts = list(ODD)
    passage = words(rng, 60)
    for _ in range(40):
        texts.append(words(rng, rng.randrange(20, 120), 5000) + "\n" + (passage if rng.random() < 0.4 else words(rng, 12, 5000)))
    for _ in range(groups):
        base = words(rng, rng.randrange(30, 90), 3000).split()
        for c in range(copies):
            near = list(base)
            for _ in range(c % 4):
                near[rng.randrange(len(near))] = f"n{rng.randrange(9999)}"
            texts.append("\n".join(" ".join(near[i:i + 10]) for i in range(0, len(near), 10)))
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def frame(spark, rows, extra=True):
    """Documents with columns whose names clash with the operators' own."""
    if extra:
        return spark.createDataFrame([(d, t, "x", "y", 1, 2, "z") for d, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, score int, key string")
    return spark.createDataFrame(rows, "doc_id long, text string")
