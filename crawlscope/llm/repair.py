"""Conversation structure repair (operator 13).

Rows (conv_id, turn, role, text) of one conversation are taken by turn and made
into ``(s?(ua)+)?`` over the initials of the roles by the cheapest edits: keep
(K, 0), rerole to user or assistant (R, 3), delete (D, 4; required for blank
and duplicate rows), insert an empty user or assistant turn anywhere (I, 3); a
truncated row that stays adds 3.  Of equally cheap audits (the edits' initials
in order) the ASCII-least wins.

The dynamic program has four states (nothing yet, a system turn, a user turn
awaits its answer, answered).  Audits are persistent: an edit is a node that
points to the one before it, so states share their beginnings.  A node has a
rolling hash of its audit and ancestors 1, 2, 4, ... edits back; equally cheap
audits are compared at their longest common beginning, found by hashes and then
verified by walking both back to the node they share (or, should a hash lie, by
the edits themselves).

Conversations are spread by id, sorted by turn and streamed: a partition holds
one conversation's open edits, never its rows in one piece.  States that another
state beats whatever follows are dropped, and edits on which all remaining
states agree are given out at once; what stays in memory of a conversation is
its undecided end and 16 bytes per different row.

Defined cases: null roles and texts are one space; an empty role counts as a
space; null turns come first and take no part in gaps; rows of one turn are
ordered by role, then text; a null conv_id is one conversation; rows with
``gone`` set only keep their conversation in the result; an empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.store import prepare
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
#: (state, initial of a kept turn) -> state
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): ASKED, (SYSTEM, "u"): ASKED, (ANSWERED, "u"): ASKED, (ASKED, "a"): ANSWERED}
LEGAL = {"su", "ua", "au"}
SETTLE = 256  # open edits at which agreement is looked for
BLANKS = " \t\n\x0b\x0c\r"
_MODULUS, _BASE = (1 << 61) - 1, 1_000_003

_EDITS = "conv_id long, step long, edit string, role string, text string, fault string, was string, turn long"
_BATCH_ROWS, _BATCH_CHARS = 1000, 4 << 20


class Edit:
    """A persistent audit: its last edit, the audit before it, and ancestors."""

    __slots__ = ("kind", "row", "role", "length", "hash", "up")

    def __init__(self, before: Edit | None, kind: str = "", row: int = -1, role: str = ""):
        self.kind, self.row, self.role = kind, row, role
        if before is None:
            self.length, self.hash, self.up = 0, 0, []
            return
        self.length = before.length + 1
        self.hash = (before.hash * _BASE + ord(kind)) % _MODULUS
        up, k = [before], 0
        while k < len(up[k].up):  # the ancestor 2**k back has one as far again
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def ancestor(self, length: int) -> Edit:
        """The audit's first ``length`` edits."""
        node = self
        while node.length > length:
            node = node.up[min(len(node.up), (node.length - length).bit_length()) - 1]
        return node

    def edits_after(self, base: Edit) -> list[Edit]:
        out, node = [], self
        while node is not base:
            out.append(node)
            node = node.up[0]
        return out[::-1]


def first_difference(a: Edit, b: Edit) -> tuple[Edit, Edit] | None:
    """The first edits in which two audits of one length differ."""
    if a is b or a.hash == b.hash and _same(a, b):
        return None
    x, y = a, b
    for k in range(max(len(x.up), 1) - 1, -1, -1):
        if k < len(x.up) and k < len(y.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if x.kind != y.kind and x.length and _same(x.up[0], y.up[0]):
        return x, y
    pairs = []  # equal hashes of different audits: compare the edits themselves
    while a is not b:
        pairs.append((a, b))
        a, b = a.up[0], b.up[0]
    return next(((p, q) for p, q in reversed(pairs) if p.kind != q.kind), None)


def _same(a: Edit, b: Edit) -> bool:
    while a is not b:
        if a.kind != b.kind:
            return False
        a, b = a.up[0], b.up[0]
    return True


def precedes(a: Edit, b: Edit) -> bool:
    """ASCII order of two audits; a beginning precedes what continues it."""
    n = min(a.length, b.length)
    found = first_difference(a.ancestor(n), b.ancestor(n))
    return found[0].kind < found[1].kind if found else a.length < b.length


class Repair:
    """The four states after some rows of a conversation: (cost, audit)."""

    def __init__(self):
        self.base = Edit(None)
        self.states: list[tuple[int, Edit] | None] = [(0, self.base), None, None, None]
        self._insert()

    @staticmethod
    def _offer(states, at, cost, before, kind, row, role):
        held = states[at]
        if held is not None and held[0] < cost:
            return
        audit = Edit(before, kind, row, role)
        if held is None or cost < held[0] or precedes(audit, held[1]):
            states[at] = (cost, audit)

    def _insert(self):
        s = self.states
        for a in (NOTHING, SYSTEM, ANSWERED):
            if s[a]:
                self._offer(s, ASKED, s[a][0] + COST[INSERT], s[a][1], INSERT, -1, "user")
        if s[ASKED]:
            self._offer(s, ANSWERED, s[ASKED][0] + COST[INSERT], s[ASKED][1], INSERT, -1, "assistant")

    def row(self, number: int, role: str, fault: str | None) -> None:
        """Take in one row."""
        states: list[tuple[int, Edit] | None] = [None] * 4
        stay = TRUNCATED if fault == "truncated" else 0
        for state, held in enumerate(self.states):
            if held is None:
                continue
            cost, audit = held
            self._offer(states, state, cost + COST[DELETE], audit, DELETE, number, role)
            if fault in ("blank", "duplicate"):
                continue
            kept = NEXT.get((state, role[0]))
            if kept is not None:
                self._offer(states, kept, cost + COST[KEEP] + stay, audit, KEEP, number, role)
            want = "assistant" if state == ASKED else "user"
            if want != role:
                self._offer(states, NEXT[state, want[0]], cost + COST[REROLE] + stay, audit, REROLE, number, want)
        self.states = states
        self._insert()
        self._drop_beaten()

    def _drop_beaten(self):
        """Whatever follows SYSTEM follows ANSWERED too, and what follows
        NOTHING does at the price of one deletion, of a system turn."""
        s, best = self.states, self.states[ANSWERED]
        if best:
            if s[SYSTEM] and best[0] < s[SYSTEM][0]:
                s[SYSTEM] = None
            if s[NOTHING] and best[0] + COST[DELETE] < s[NOTHING][0]:
                s[NOTHING] = None

    def settled(self, end: bool) -> tuple[list[Edit], int | None]:
        """Edits that are decided, and (at the end) the cost.  What is given
        out is cut off the audits that remain."""
        if end:
            cost, audit = min((s for s in (self.states[NOTHING], self.states[ANSWERED]) if s), key=_order)
            return audit.edits_after(self.base), cost
        held = [s for s in self.states if s]
        shared = held[0][1]
        for _, audit in held[1:]:
            n = min(shared.length, audit.length)
            a, b = shared.ancestor(n), audit.ancestor(n)
            for k in range(len(a.up) - 1, -1, -1):
                if k < len(a.up) and a.up[k] is not b.up[k]:
                    a, b = a.up[k], b.up[k]
            shared = a if a is b else a.up[0]
        out = shared.edits_after(self.base)
        copies = {id(shared): Edit(None)}
        self.base = copies[id(shared)]
        for k, s in enumerate(self.states):
            if s:
                for node in s[1].edits_after(shared):
                    if id(node) not in copies:
                        copies[id(node)] = Edit(copies[id(node.up[0])], node.kind, node.row, node.role)
                self.states[k] = (s[0], copies[id(s[1])])
        return out, None


class _order:
    """Sorts (cost, audit) by cost, then ASCII."""

    def __init__(self, held):
        self.held = held

    def __lt__(self, other):
        (c, a), (d, b) = self.held, other.held
        return c < d if c != d else precedes(a, b)


def fault_of(role: str, text: str, seen: set[bytes]) -> str | None:
    """A row's first fault; ``seen`` learns the row."""
    end = text.rstrip(BLANKS)
    if not end:
        return "blank"
    mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if mark in seen:
        return "duplicate"
    seen.add(mark)
    return None if end[-1] in ".!?" else "truncated"


def _edit_rows(conversation, rows):
    """Edit rows of one conversation, as it is read."""
    work, seen, waiting, step, number = Repair(), set(), {}, 0, 0

    def give(edits):
        nonlocal step
        for e in edits:
            turn, was, text, fault = waiting.pop(e.row) if e.row >= 0 else (None, None, "", None)
            yield conversation, step, e.kind, e.role, text, fault, was, turn
            step += 1
    threshold = SETTLE
    for turn, role, text, gone in rows:
        if gone:
            continue
        role = role or " "
        fault = fault_of(role, text, seen)
        waiting[number] = (turn, role, text, fault)
        work.row(number, role, fault)
        number += 1
        if len(waiting) >= threshold:
            yield from give(work.settled(False)[0])
            threshold = max(SETTLE, 2 * len(waiting))
    yield from give(work.settled(True)[0])
    if not number:
        yield conversation, None, None, None, None, None, None, None


def _conversations(batches, columns):
    """(id, iterator of rows) of neighbouring rows with one conv_id."""
    from itertools import groupby

    def flat():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns))
    for key, rows in groupby(flat(), key=lambda r: r[0]):
        yield key, (r[1:] for r in rows)


def _batches(rows, schema: pa.Schema, text: int | None):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "") if text is not None else 0
        if len(held) >= _BATCH_ROWS or size >= _BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def repair(rows: DataFrame) -> DataFrame:
    """One row per edit, in order within a partition that holds all of its
    conversation: conv_id, step, edit, role and text (after the edit), and for
    edits of a row its fault, its role before (``was``) and turn.  A conversation
    without rows gives one row of nulls.  ``rows`` may have a boolean ``gone``."""
    prepare(rows.sparkSession)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.when(gone, F.lit("")).otherwise(F.coalesce(F.col("text").cast("string"), F.lit(" "))).alias("text"), gone.alias("gone"))
    dealt = given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = _arrow(_EDITS)

    def run(batches):
        found = _conversations(batches, ["conv_id", "turn", "role", "text", "gone"])
        yield from _batches((e for conv, its in found for e in _edit_rows(conv, its)), schema, 4)
    return dealt.mapInArrow(run, _EDITS)


_SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, repaired_sha256 string")


def _summary(conversation, edits):
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    illegal = cost = distinct = 0
    low = last = before = None
    audit, digest, first = [], hashlib.sha256(), True
    for _, kind, role, text, fault, was, turn in edits:
        if kind is None:
            continue
        audit.append(kind)
        cost += COST[kind]
        if fault:
            faults[fault] += 1
            cost += TRUNCATED if fault == "truncated" and kind != DELETE else 0
        if was is not None:
            illegal += before is not None and before + was[0] not in LEGAL
            before = was[0]
            if turn is not None:
                low = turn if low is None else low
                distinct += turn != last
                last = turn
        if kind != DELETE:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
    gaps = 0 if low is None else last - low + 1 - distinct
    return (conversation, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest())


def summarize(edits: DataFrame) -> DataFrame:
    """One row per conversation from the rows of ``repair``, which must still be
    in its order."""
    schema = _arrow(_SUMMARY)

    def run(batches):
        found = _conversations(batches, ["conv_id", "step", "edit", "role", "text", "fault", "was", "turn"])
        yield from _batches((_summary(conv, its) for conv, its in found), schema, 7)
    return edits.mapInArrow(run, _SUMMARY)


def damage(conversations: DataFrame) -> DataFrame:
    """Damages rows by crc32 of ``conv_id:turn``, a null being one space, modulo
    20: 0 drops a row (``gone``), 1 empties its text, 2 takes [.!?] out of it, 3
    repeats it, 4 makes its role user."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), space).alias("role"),
                                F.coalesce(F.col("text").cast("string"), space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("harm", F.crc32(name.cast("binary")) % 20)
    text = (F.when(F.col("harm") <= 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("harm") == 0).alias("gone"),
                       F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Operator 13 over the whole damaged ``conversations`` table."""
    from crawlscope.sources.tables import load

    return summarize(repair(damage(load(spark, sf_dir, "conversations"))))


# crc32 is taken bit by bit, and the four states run through the rows of all
# conversations at once; a gap takes up to two inserted turns.
ORACLE_SQL = r"""
with recursive g as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
         list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: unicode(x)::bigint) b
  from conversations),
h as (select * exclude b, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b), lambda c, x:
        list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                    lambda v, z: if(v % 2 = 1, xor(v >> 1, 3988292384), v >> 1)))) % 20 harm from g),
d as (select conv_id, turn, if(harm = 4, 'user', role) role,
             case when harm = 1 then '' when harm = 2 then translate(text, '.!?', '') else text end text,
             unnest(if(harm = 3, [1, 2], [1])) again from h where harm <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) i from d),
f as (select conv_id, i, turn, role, text, substr(role, 1, 1) initial,
             case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                  when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end fault,
             count(*) over (partition by conv_id) n from o),
w(conv_id, i, n, state, cost, audit, script) as (
  select conv_id, 0::bigint, n, v.state, v.cost::bigint, v.audit, v.script
  from (select distinct conv_id, n from f),
       (values (0, 0, '', ''), (2, 3, 'I', 'user:'), (3, 6, 'II', 'user:' || chr(10) || 'assistant:')) v(state, cost, audit, script)
  union all
  (select conv_id, i, n, state, cost, audit, script from (
    with kept as (
      select w.conv_id, f.i, w.n, e.edit, w.cost, w.audit, w.script, f.role, f.text, f.fault, w.state from_state,
             case e.edit when 'D' then w.state
                         when 'K' then case when w.state = 0 and f.initial = 's' then 1
                                            when w.state in (0, 1, 3) and f.initial = 'u' then 2
                                            when w.state = 2 and f.initial = 'a' then 3 end
                         else if(w.state = 2, 3, 2) end state
      from w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1,
           (values ('D'), ('K'), ('R')) e(edit)
      where e.edit = 'D' or f.fault not in ('blank', 'duplicate')),
    made as (
      select conv_id, i, n, state, audit || edit audit,
             cost + case edit when 'D' then 4 when 'R' then 3 else 0 end + if(edit <> 'D' and fault = 'truncated', 3, 0) cost,
             if(edit = 'D', script, script || if(script = '', '', chr(10)) ||
                if(edit = 'K', role, if(state = 3, 'assistant', 'user')) || ':' || text) script
      from kept where state is not null),
    grown as (
      select conv_id, i, n, x.more,
             if(x.more = 0, state, if(state = 2, 3, 2)) state1, if(x.more = 2, if(state = 2, 2, 3), null) state2,
             cost + 3 * x.more cost, audit || repeat('I', x.more) audit,
             script || case when x.more = 0 then '' else
               if(script = '', '', chr(10)) || if(state = 2, 'assistant:', 'user:') ||
               if(x.more = 2, chr(10) || if(state = 2, 'user:', 'assistant:'), '') end script
      from made, (values (0), (1), (2)) x(more))
    select conv_id, i, n, coalesce(state2, state1) state, cost, audit, script from grown)
   qualify row_number() over (partition by conv_id, state order by cost, audit) = 1)),
best as (select conv_id, cost, audit, script from w where i = n and state in (0, 3)
         qualify row_number() over (partition by conv_id order by cost, audit) = 1),
s as (select conv_id, if(max(turn) is null, 0, max(turn) - min(turn) + 1 - count(distinct turn)) gaps,
             count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
             count(*) filter (fault = 'truncated') truncated,
             count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal
      from (select *, lag(initial) over (partition by conv_id order by i) || initial pair from f) group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
       coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(cost, 0)::bigint cost,
       coalesce(audit, '') audit, sha256(coalesce(script, '')) repaired_sha256
from (select distinct conv_id from conversations) c
left join s on s.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id
"""
