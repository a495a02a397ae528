"""Filter interaction audit (operator 12) by the Hart-Mas-Colell potential.

Every document gets the set of filters that it fails.  Per part (a source), the
removal game's value v(S) is the number of documents that fail a filter of the
coalition S.  The potential follows the recursion

    P(empty) = 0,  |S| P(S) = v(S) + sum of P(S without i) over i in S

over the 2^n coalitions, and a filter's Shapley value is P(all) - P(all without
it).  All is held in whole numbers, as n! P(S) is one.  What a filter removes
as step k of an order is v(S with it) - v(S), S being the filters before it.

Only a hash, an id and a part of each document are shuffled.  Rows are counted
by (text, id, part, failures) before they meet their labels, so a text, an id
or a part that holds a third of all rows is a few rows by then.

Defined cases: null text is empty; a null source is the part ''; a document is
a copy if a row with a smaller doc_id holds the same text, so rows that repeat
the first doc_id are none, and a null doc_id neither is a copy nor makes one;
of repeated labels the larger holds, a null label is 0; an empty table has no
parts and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscope.llm.store import save

_SPACES = r"[\x20\x09-\x0D]+"
COPY = "copy"  # marks the filter that looks at the whole table


def words(text: Column) -> Column:
    """Maximal runs of anything but space and tab to carriage return."""
    return F.array_remove(F.split(text, _SPACES), "")


def default_filters() -> dict[str, Column | str]:
    """Letter -> failure condition over ``text`` and ``words``, or COPY."""
    letters = "".join(map(chr, range(65, 91)))
    capitals = F.length("text") - F.length(F.translate("text", letters, ""))
    return {
        "A": F.size("words") < 50,
        "B": 100 * F.size(F.array_distinct("words")) < 65 * F.size("words"),
        "C": 100 * capitals > 5 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
        "E": COPY,
    }


def failures(docs: DataFrame, filters: dict[str, Column | str]) -> DataFrame:
    """(doc_id, part, body, mask, n): rows counted by what they hold.  ``body``
    is the text's SHA-256, ``mask`` has bit k for the k-th filter failed, the
    COPY one left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    mask = sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(filters.values()) if not isinstance(test, str)), F.lit(0))
    return (rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("body"), mask.alias("mask"))
            .groupBy("doc_id", "part", "body", "mask").agg(F.count("*").alias("n")))


def failure_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str]) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failures."""
    copy = sum(1 << k for k, test in enumerate(filters.values()) if isinstance(test, str))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    rows = failures(docs, filters)
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    rows = save(known.unionByName(nameless).na.fill(0, ["good", "toxic"]), "failures")

    def counted(part: DataFrame, mask: Column, sign: int) -> DataFrame:
        return part.select("part", mask.alias("mask"), *[(sign * F.col("n") * m).alias(c) for c, m in
                                                         (("n", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic")))])
    named = rows.where("doc_id is not null")
    if copy:
        # All named rows count as copies, then the first of each text are taken out again.
        first = named.join(named.groupBy("body").agg(F.min("doc_id").alias("doc_id")), ["body", "doc_id"], "left_semi")
        bit = F.col("mask").bitwiseOR(F.lit(copy))
        parts = [counted(named, bit, 1), counted(first, bit, -1), counted(first, F.col("mask"), 1)]
    else:
        parts = [counted(named, F.col("mask"), 1)]
    every = counted(rows.where("doc_id is null"), F.col("mask"), 1)
    for p in parts:
        every = every.unionByName(p)
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def games(counts: DataFrame, n_filters: int) -> DataFrame:
    """One row per part: total, and by coalition (index = set of bits) the
    arrays removed, good, toxic (values of the games) and potential (n! times
    the potential of ``removed``); ``only`` has the documents per mask."""
    size = 1 << n_filters

    def value(column: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, F.col(column)).otherwise(0)) for s in range(size)])
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("total"), value("n").alias("removed"), value("good").alias("good"), value("toxic").alias("toxic"),
        F.array(*[F.sum(F.when(F.col("mask") == s, F.col("n")).otherwise(0)) for s in range(size)]).alias("only"))
    scale = factorial(n_filters)
    parts = parts.withColumn("p0", F.lit(0).cast("long"))
    for members in range(1, n_filters + 1):  # coalitions of one size need those one smaller
        parts = parts.withColumns({
            f"p{s}": F.expr(f"({scale}L * removed[{s}] + " + " + ".join(f"p{s & ~(1 << i)}" for i in range(n_filters) if s >> i & 1) + f") div {members}")
            for s in range(size) if s.bit_count() == members})
    return parts.select("part", "total", "removed", "good", "toxic", "only",
                        F.array(*[f"p{s}" for s in range(size)]).alias("potential"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | str] | None = None) -> DataFrame:
    """One row per part, order of the filters and step."""
    filters = filters or default_filters()
    letters = list(filters)
    n, whole = len(letters), (1 << len(letters)) - 1
    # Save the games: 600 rows per part are made of each.
    parts = save(games(failure_counts(docs, labels, filters), n), "games")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = (parts.withColumn("filter_order", F.explode(orders))
             .select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter")))
    bit = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)]), F.col("letter"))
    before = sum((F.when(F.instr(F.substr("filter_order", F.lit(1), F.col("place")), c) > 0, 1 << k).otherwise(0)
                  for k, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumns({"bit": bit, "before": before}).withColumn("after", F.col("before") + F.col("bit"))

    def gain(game: str) -> Column:
        return F.get(game, F.col("after")) - F.get(game, F.col("before"))
    return steps.select(
        "part", "filter_order", (F.col("place") + 1).cast("int").alias("step"),
        (F.col("total") - F.get("removed", F.col("after"))).alias("kept"), gain("removed").alias("removed"),
        (F.get("removed", F.col("bit")) - gain("removed")).alias("redundant"), F.get("only", F.col("bit")).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(whole)) - F.get("potential", F.lit(whole) - F.col("bit"))).alias("shapley"))


def op12_filter_interaction_audit(spark, sf_dir: str) -> DataFrame:
    """Operator 12 over the whole ``documents`` and ``labels`` tables."""
    from crawlscope.sources.tables import load

    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
with l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
m as (select part, coalesce(l.good, 0) good, coalesce(l.toxic, 0) toxic,
        (len(w) < 50)::int a, (100 * len(list_distinct(w)) < 65 * len(w))::int b,
        (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::int c,
        regexp_matches(t, '[#$%&*|]')::int d, coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int e
      from d left join l on d.doc_id = l.doc_id),
c as (select part, concat(if(a = 1, 'A', ''), if(b = 1, 'B', ''), if(c = 1, 'C', ''), if(d = 1, 'D', ''), if(e = 1, 'E', '')) fails,
             count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select v.x || w.x || y.x || z.x || u.x filter_order from f v, f w, f y, f z, f u
      where len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5),
s as (select filter_order, step::int step, substr(filter_order, step, 1) x, substr(filter_order, 1, step - 1) earlier
      from o, range(1, 6) t(step)),
r as (select part, filter_order, step, x, fails, n, good, toxic,
             earlier <> '' and regexp_matches(fails, '[' || earlier || '0]') gone, contains(fails, x) failing from c, s)
select part, filter_order, step,
       coalesce(sum(n) filter (not gone and not failing), 0)::bigint kept,
       coalesce(sum(n) filter (not gone and failing), 0)::bigint removed,
       coalesce(sum(n) filter (gone and failing), 0)::bigint redundant,
       coalesce(sum(n) filter (fails = x), 0)::bigint unique_fails,
       coalesce(sum(good) filter (not gone and failing), 0)::bigint good_lost,
       coalesce(sum(toxic) filter (not gone and failing), 0)::bigint toxic_lost,
       (sum(coalesce(sum(n) filter (not gone and failing), 0)) over (partition by part, x))::bigint shapley
from r group by part, filter_order, step, x
"""
