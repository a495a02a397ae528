"""Operator 13 against plain strings, exhaustive search and false hashes."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from crawlscope.llm import repair

from .common import ODD

COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, repaired) with whole strings in every state."""
    flaws = faults(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def grow(states):
        for _ in range(3):
            for state, (cost, audit, made) in list(states.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 3, audit + "I", (*made, (role, "")))
                to = role[0]
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states
    states = grow({"": (0, "", ())})
    for (role, text), flaw in zip(rows, flaws):
        new = {}

        def offer(state, cost, audit, made):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, made)
        for state, (cost, audit, made) in states.items():
            offer(state, cost + 4, audit + "D", made)
            if flaw in ("blank", "duplicate"):
                continue
            stay = 3 if flaw == "truncated" else 0
            if (state, role[0]) in step:
                offer(step[state, role[0]], cost + stay, audit + "K", (*made, (role, text)))
            want = "assistant" if state == "u" else "user"
            offer(want[0], cost + stay + 3, audit + "R", (*made, (want, text)))
        states = grow(new)
    return min(states[s] for s in ("", "a") if s in states)


def engine(rows, modulus=None):
    out = list(repair._edit_rows(1, [(k, r, t, False) for k, (r, t) in enumerate(rows)]))
    edits = [e for e in out if e[2] is not None]
    cost = sum(COST[e[2]] + (3 if e[5] == "truncated" and e[2] != "D" else 0) for e in edits)
    return cost, "".join(e[2] for e in edits), tuple((e[3], e[4]) for e in edits if e[2] != "D")


def random_rows(rng, n):
    texts = ["One.", "two", "", " \n", "Three!", "four?", "five  ", "six", "x"]
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " "]), rng.choice(texts) + (str(k) + rng.choice([".", ""]) if rng.random() < 0.7 else ""))
            for k in range(n)]


def test_audits_equal_plain_strings():
    rng = random.Random(1)
    for _ in range(1500):
        rows = random_rows(rng, rng.randrange(0, 14))
        assert engine(rows) == plain(rows)


def test_long_conversations_settle_as_they_go(monkeypatch):
    monkeypatch.setattr(repair, "SETTLE", 16)
    rng = random.Random(2)
    for n in (90, 260):
        rows = random_rows(rng, n)
        assert engine(rows) == plain(rows)
    alternating = [(("user", "assistant")[k % 2], f"{k}.") for k in range(5000)]
    assert engine(alternating)[:2] == (0, "K" * 5000)


def test_nothing_cheaper_exists():
    """All edit strings with up to one insertion per gap, by their grammar."""
    rng = random.Random(3)
    for _ in range(40):
        rows = random_rows(rng, rng.randrange(1, 4))
        flaws, best = faults(rows), None
        choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in flaws]
        inserts = ["", "u", "a", "ua", "au"]
        for edits in product(*choices):
            for gaps in product(inserts, repeat=len(rows) + 1):
                roles = audit = gaps[0].replace("u", "I").replace("a", "I")
                roles, cost = gaps[0], 3 * len(gaps[0])
                for (role, _), flaw, e, gap in zip(rows, flaws, edits, gaps[1:]):
                    audit += e[0] + "I" * len(gap)
                    roles += ("" if e == "D" else role[0] if e == "K" else e[1]) + gap
                    cost += COST[e[0]] + 3 * len(gap) + (3 if flaw == "truncated" and e != "D" else 0)
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert engine(rows)[:2] == best


@pytest.mark.parametrize("modulus", [1, 2, 5])
def test_false_hashes_are_found_out(monkeypatch, modulus):
    monkeypatch.setattr(repair, "_MODULUS", modulus)
    rng = random.Random(4)
    for _ in range(300):
        rows = random_rows(rng, rng.randrange(0, 20))
        assert engine(rows) == plain(rows)


def brute(table):
    groups = {}
    for conv, turn, role, text, *_ in table:
        rows = groups.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        rows += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        pairs = [(r or " ", t) for _, r, t in rows]
        turns = [t for t, *_ in rows if t is not None]
        flaws = faults(pairs)
        illegal = sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, made = plain(pairs)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, flaws.count("blank"), flaws.count("duplicate"),
                    flaws.count("truncated"), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_registered_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    table = []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", None, ""])
            table.append((conv, turn if rng.random() < 0.9 else None, role, rng.choice([*ODD, "Fine.", "Really?", "Yes!"]), "e", 0, "d"))
    table += [(500, k, ("user", "assistant")[k % 2], f"{k}!", "e", 0, "d") for k in range(700)]
    table += [table[3]] * 3
    rng.shuffle(table)
    schema = "conv_id long, turn long, role string, text string, edit string, step long, fault string"
    spark.createDataFrame(table, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    out = repair.op13_conversation_repair(spark, str(tmp_path))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(table)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.summarize(repair.repair(rows)).count() == 0
