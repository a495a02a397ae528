"""Chat formatting from reply trees (operator 3), DataFrame functions only.

Messages are rows (tree_id, msg_id, parent_id, role, text, score).  Iterative
self-joins with pointer doubling (each round jumps twice as far towards the
root) give every message its distance from the root and the scores on its way,
so the number of joins is the logarithm of the deepest tree.  Leaves are ranked
within their tree by mean score, and the messages on the chosen root-to-leaf
paths are gathered by the same jumps and formatted as one conversation each.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Control strings
inside roles and texts get a backslash after their first character (one more if
some are there already), which unescaping takes away again.

Defined cases: null roles and texts are empty; of rows that repeat a tree_id
and msg_id the smallest stays; a parent that does not exist makes its child a
root; messages on a cycle belong to no tree and are left out; null tree_ids
form one tree; ties between branches go to the smaller leaf; an empty table
gives no conversation.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.store import save

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

# Control strings of common chat templates, as first character and rest.
_REST = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*)({_REST})"
_UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")  # a doubled backslash is one, \n between them a line end
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """([(t, node, jump) for jumps of 1, 2, 4, ... messages], state) where state
    has each message's depth (1 at a root) and total score from the root."""
    nodes = messages.select("t", "node", F.col("parent").alias("want"), "score")
    known = messages.select("t", F.col("node").alias("want"), F.col("node").alias("jump"))
    state = save(nodes.join(known, ["t", "want"], "left")
                 .select("t", "node", "jump", F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "jumps")
    levels, rounds = [], 0
    limit = max(1, state.count()).bit_length() + 1
    while rounds < limit and state.where("jump is not null").limit(1).count():
        levels.append(state.where("jump is not null").select("t", "node", "jump"))
        up = state.select("t", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("total").alias("more"), F.col("depth").alias("far"))
        done = state.where("jump is null")
        state = save(state.where("jump is not null").join(up, ["t", "jump"])
                     .select("t", "node", F.col("next").alias("jump"), (F.col("total") + F.col("more")).alias("total"),
                             (F.col("depth") + F.col("far")).alias("depth")).unionByName(done), "jumps")
        rounds += 1
    return levels, state.where("jump is null")


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(t, leaf, depth, node) of the ``top`` best root-to-leaf paths per tree."""
    levels, state = jumps(messages)
    leaves = state.join(messages.select("t", F.col("parent").alias("node")).where("node is not null").distinct(), ["t", "node"], "left_anti")
    order = Window.partitionBy("t").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    path = save(chosen.select("t", F.col("node").alias("leaf"), "node"), "path")
    for level in levels:
        path = save(path.unionByName(path.join(level, ["t", "node"]).select("t", "leaf", F.col("jump").alias("node"))), "path")
    return path.join(state.select("t", "node", "depth"), ["t", "node"])


def format_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """One row per chosen path: tree_id, leaf, formatted, loss (array of start
    from 1 and length, in code points, of the assistant texts in it)."""
    name = F.col("tree_id").cast("string")
    key = F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name))  # no tree's name is that of rows without one
    rows = (messages.groupBy(key.alias("t"), F.col("msg_id").alias("node"))
            .agg(F.min(F.struct(F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), F.col("parent_id").alias("parent"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                                F.col("tree_id").alias("tree_id"))).alias("m")).select("t", "node", "m.*"))
    rows = save(rows, "messages")
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = (best_paths(rows, top).join(rows, ["t", "node"])
             .select("tree_id", "t", "leaf", "depth", (F.col("role") == "assistant").alias("learn"),
                     F.length(head).alias("skip"), F.length(body).alias("size"),
                     F.concat(head, body, F.lit(CLOSE + "\n")).alias("turn")))
    before = F.sum(F.length("turn")).over(Window.partitionBy("t", "leaf").orderBy("depth")) - F.length("turn")
    turns = turns.withColumn("start", before + F.col("skip") + 1)
    line = F.sort_array(F.collect_list(F.struct("depth", "learn", "start", "size", "turn")))
    return (turns.groupBy("t", "leaf").agg(F.first("tree_id").alias("tree_id"), line.alias("turns"))
            .select("tree_id", "leaf", F.array_join("turns.turn", "").alias("formatted"),
                    F.transform(F.filter("turns", lambda x: x["learn"]),
                                lambda x: F.struct(x["start"].cast("int").alias("start"), x["size"].alias("size"))).alias("loss")))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turn(block):
        inner = F.substr(block, F.lit(len(OPEN) + 1))
        cut = F.instr(inner, "\n")
        return F.struct(_unescape_role(F.substr(inner, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substr(inner, cut + 1)).alias("text"))
    return F.transform(blocks, turn)


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of conversations kept as rows by turn: each answers the one
    before it (ties by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id").alias("tree_id"), n.alias("msg_id"), F.when(n > 1, n - 1).alias("parent_id"),
                                "role", "text", F.lit(0.0).alias("score"))


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over all ``conversations`` plus conversation -1."""
    from crawlscope.sources.tables import load

    probe = spark.sql("""SELECT -1L conv_id, turn, role, '</s>[INST] ok [/INST]' text
                         FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)""")
    rows = load(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    out = format_paths(linear(rows)).withColumn("turns", read_back(F.col("formatted")))
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"], s["size"]))), "")
    script = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(script, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
                      F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
           union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, regexp_replace(t, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g') x from c)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
       coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
       sum(length('<|im_start|>') + length(r) + 1 + length(x) + length('<|im_end|>') + 1)::bigint formatted_chars
from e group by conv_id
"""
