"""Connected components of a similarity join, without listing all pairs.

``components_of_shared`` gets blocking keys that every linked pair shares, and a metric.
A group of mutual near copies would yield the square of its size in pairs, so
links are looked for in two rounds:

1. within each key every member is compared with the most central one only (a
   star): the one whose keys have most members in all.  A text that many others
   are edited from shares nearly all its keys with them, while each of them has
   keys of its own, so most of a group is linked with it at once; verified links
   are closed to first components;
2. what remains are keys whose members lie in different components.  Two
   components are compared by their smallest members first, and by the triangle
   inequality dropped together where even their closest members are too far
   apart; of the pairs left, those members are compared one by one that are
   far enough from their own smallest member to reach the other component.

Where more than ``HOT`` components meet in one key and the metric can tell
parts, the second round lists no pairs of components.  Each member keeps what
sets it apart from the key's centre, a set of parts.  Two linked members are
apart by little, so if one is far from the centre, the other has most of the
same parts: they share one of the rarest, and only those who do are compared.
Two members near the centre meet by a shared part as well, unless both have so
few that they need not share any; only those are compared directly.  How often a part occurs is told by a table of ``CELLS`` counters, too
high at times but never too low: it only has to put the parts in one order for
all, and parts that it has once are nobody else's and go nowhere.  Many parts
fill the table; the join then does all the work.

All rounds verify exactly, so the components are those of the full join.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.store import discard, save
from crawlscope.llm.words import mix
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

HOT = 1  # components meeting in one key above which members are told apart by their parts
CELLS = 1 << 24  # counters of parts, one byte each, whatever the data
_PAGE = 1 << 14  # counters in one row


def connected(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of ``edges`` (a, b); comp is the smallest id it
    is connected with.  Alternates large-star and small-star steps."""
    e = save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        roots = e.select(F.col("v").alias("u"), F.lit(1).alias("root")).distinct()
        n, heads, inner = e.join(roots, "u", "left").agg(F.count("*"), F.count_distinct("u"), F.count("root")).first()
        if n == heads and not inner:  # every id has one edge, to an id that has none: stars
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = save(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select("u", F.col("m").alias("v")).unionByName(
            near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        following = save(small, "edges")
        discard(e)
        discard(large)
        e = following
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, id, n) for keys that at least two different ids have; n counts the
    key's rows.  One shuffle; as an id has many keys, no key can hold
    more than a small share of the rows."""
    over = Window.partitionBy("key")
    rows = keys.withColumn("low", F.min("id").over(over)).withColumn("high", F.max("id").over(over)).withColumn("n", F.count("*").over(over))
    return rows.where("low != high").select("key", "id", "n").distinct()


def centres(shared: DataFrame) -> DataFrame:
    """(key, centre): of each key's members the one whose keys have most members."""
    central = shared.groupBy("id").agg(F.sum("n").alias("central"))
    return shared.select("key", "id").join(central, "id").groupBy("key").agg(F.max(F.struct("central", "id")).alias("c")).select("key", F.col("c.id").alias("centre"))


def components_of_shared(shared: DataFrame, compare: Callable[[DataFrame], DataFrame], distance: Callable[[DataFrame], DataFrame],
                         reach: Callable[[DataFrame], DataFrame], parts: Callable[[DataFrame], DataFrame] | None = None,
                         agree: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, comp) of every id that is linked with another one.

    ``shared``: rows of ``shared_keys``; every linked pair shares a
    key.  ``compare``: (a, b) pairs -> (a, b, low, linked), where low is a
    lower bound of their distance.  ``distance``: pairs -> (a, b, far), exact,
    or (a, b, near, far), a lower and an upper bound of it: what is dropped
    must be too far apart by ``near``, members stretch as far as ``far``.
    ``reach``: (id) -> (id, reach), the distance up to which an id may be
    linked to anything.  ``parts``: (centre, id) -> (centre, id, parts, near,
    need, within): the parts that set the id apart from its centre; whether they
    are at most ``within``, so that it may be linked with members that share
    none; how many of them any member linked with it has that is not near (1
    for near members, if being near is not being linked with the centre); by how
    many parts, at most, linked members differ.  ``agree``: (id) -> (id, agree),
    the least number of keys that the id shares with any member linked with it.
    """
    middle = save(centres(shared), "centres")
    spokes = shared.join(middle, "key").where("id != centre")
    star = save(compare(spokes.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()), "star")
    links = star.where("linked").select("a", "b")
    first = save(connected(links), "first")
    rows = shared.join(first, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    # of a key with two members the star has compared all
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x != y and n > 2").select("key")
    rows = save(rows.join(mixed, "key"), "mixed")
    if agree is not None:
        rows = _agreeing(rows, agree)
    members_met = None
    if parts is not None:
        hot = save(rows.groupBy("key").agg(F.countDistinct("comp").alias("n")).where(F.col("n") > HOT).select("key"), "hot")
        if hot.limit(1).count():
            spokes = save(parts(_around(save(rows.join(hot, "key").join(middle, "key"), "hot"))), "parts")
            members_met = _meeting(spokes, first, compare)
            discard(spokes)
            rows = rows.join(hot, "key", "left_anti")
    if not rows.limit(1).count():
        if members_met is None:
            return first
        return connected(links.unionByName(save(compare(members_met[0]), "found").where("linked").select("a", "b")).unionByName(members_met[1]))
    met = rows.select("key", "comp").distinct()
    pairs = (met.select("key", F.col("comp").alias("a")).join(met.select("key", F.col("comp").alias("b")), "key")
             .where("a < b").select("a", "b").distinct())
    known = star.select("a", "b", "low", "linked")
    pairs = save(pairs.join(known, ["a", "b"], "left"), "pairs")
    fresh = compare(pairs.where("low is null").select("a", "b"))
    pairs = save(pairs.where("low is not null").unionByName(fresh), "pairs")

    # how far each component stretches from its smallest member
    used = pairs.select(F.col("a").alias("comp")).unionByName(pairs.select(F.col("b").alias("comp"))).distinct()
    members = save(first.join(used, "comp", "left_semi"), "members")
    spread = save(distance(members.where("id != comp").select(F.col("comp").alias("a"), F.col("id").alias("b")))
                  .select(F.col("a").alias("comp"), F.col("b").alias("id"), "far"), "spread")
    widest = spread.groupBy("comp").agg(F.max("far").alias("radius"))
    span = (reach(used.select(F.col("comp").alias("id")).unionByName(members.select("id")).distinct())
            .join(members.select("id", "comp"), "id", "left").groupBy(F.coalesce("comp", "id").alias("comp")).agg(F.max("reach").alias("reach")))
    span = span.join(widest, "comp", "left").select("comp", "reach", F.coalesce("radius", F.lit(0)).alias("radius"))
    near = (pairs.where("not linked")
            .join(span.select(F.col("comp").alias("a"), F.col("reach").alias("reach_a"), F.col("radius").alias("radius_a")), "a")
            .join(span.select(F.col("comp").alias("b"), F.col("reach").alias("reach_b"), F.col("radius").alias("radius_b")), "b")
            .select("a", "b", "low", "radius_a", "radius_b", F.least("reach_a", "reach_b").alias("reach"))
            .where("radius_a > 0 or radius_b > 0").where("low - reach <= radius_a + radius_b"))
    near = save(near, "near")
    # the bound was cheap; with the distance, or a closer bound, few pairs stay
    apart = distance(near.select("a", "b"))
    apart = apart.select("a", "b", F.col("near" if "near" in apart.columns else "far").alias("apart"))
    near = save(near.join(apart, ["a", "b"]).withColumn("slack", F.col("apart") - F.col("reach"))
                .where("slack <= radius_a + radius_b").drop("apart", "low", "reach"), "near")
    # members that may reach the other component; a pair of them is looked at
    # once, however many keys it shares
    every = members.select("comp", "id").unionByName(used.join(members.select("comp"), "comp", "left_anti").select("comp", F.col("comp").alias("id")))
    every = every.join(spread, ["comp", "id"], "left").select("comp", "id", F.coalesce("far", F.lit(0)).alias("far"))
    left = (every.join(near, every["comp"] == near["a"]).where("far + radius_b >= slack")
            .select("a", "b", F.col("id").alias("i"), F.col("far").alias("far_i"), "slack"))
    right = (every.join(near, every["comp"] == near["b"]).where("far + radius_a >= slack")
             .select("a", "b", F.col("id").alias("j"), F.col("far").alias("far_j")))
    detail = (left.join(right, ["a", "b"]).where("far_i + far_j >= slack")
              .select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct())
    if members_met is not None:
        detail = detail.unionByName(members_met[0]).distinct()
        links = links.unionByName(members_met[1])
    found = save(compare(detail), "found").where("linked").select("a", "b")
    return connected(links.unionByName(pairs.where("linked").select("a", "b")).unionByName(found))


def _agreeing(rows: DataFrame, agree: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (key, id, comp) without ids that have fewer keys left than they
    share with any id linked with them, and without keys that only one
    component is left with."""
    least = save(agree(rows.select("id").distinct()), "agree")
    for _ in range(2):
        enough = rows.groupBy("id").agg(F.count("*").alias("n")).join(least, "id").where("n >= agree").select("id")
        left = rows.join(enough, "id", "left_semi")
        mixed = left.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
        following = save(left.join(mixed, "key", "left_semi"), "mixed")
        discard(rows)
        rows = following
    discard(least)
    return rows


def _around(hot: DataFrame) -> DataFrame:
    """(centre, id) of the members of hot keys.  Any id serves as the centre of
    a key as long as all its members are told apart from the same one, so keys
    whose own centre lies in a greater key take that one's."""
    weight = hot.groupBy("centre").agg(F.count("*").alias("weight"))
    best = (hot.select("id", "centre").distinct().join(weight, "centre").groupBy("id")
            .agg(F.max(F.struct("weight", "centre")).alias("best")).select(F.col("id").alias("centre"), F.col("best.centre").alias("great")))
    return hot.select("centre", "id").distinct().join(best, "centre").select(F.col("great").alias("centre"), "id").distinct()


def _cells(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, part, cell) of the parts of a batch of spokes."""
    listed = batch.column("parts")
    bounds = listed.offsets.to_numpy()
    part = listed.values.to_numpy()[bounds[0]:bounds[-1]]
    row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    centre = mix(batch.column("centre").to_numpy().view(np.uint64))
    return row, part, (mix(part.view(np.uint64) ^ centre[row]) & np.uint64(CELLS - 1)).astype(np.int64)


def _part_counts(spokes: DataFrame):
    """Broadcast table of how many spokes have a part, by the part's cell; 255
    stands for all higher counts."""
    def tally(batches):
        counts = np.zeros(CELLS, dtype=np.uint8)
        for batch in batches:
            cell, n = np.unique(_cells(batch)[2], return_counts=True)
            counts[cell] = np.minimum(counts[cell] + n, 255)
        cell = np.flatnonzero(counts)
        page, start = np.unique(cell // _PAGE, return_index=True)
        ends = np.append(start, len(cell)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(page, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(cell % _PAGE, pa.int32())),
                                          pa.ListArray.from_arrays(ends, pa.array(counts[cell].astype(np.int32)))], names=["page", "cell", "n"])

    def total(batches):
        pages = {}
        for batch in batches:
            cells, counts = batch.column("cell"), batch.column("n")
            for k, page in enumerate(batch.column("page").to_pylist()):
                pages.setdefault(page, np.zeros(_PAGE, dtype=np.int64))[cells[k].values.to_numpy()] += counts[k].values.to_numpy()
        for page, counts in pages.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.minimum(counts, 255).astype(np.uint8).tobytes()], pa.binary())], names=["page", "counts"])
    tallied = spokes.select("centre", "parts").mapInArrow(tally, "page int, cell array<int>, n array<int>")
    counts = np.zeros(CELLS, dtype=np.uint8)
    for page, raw in tallied.repartition("page").mapInArrow(total, "page int, counts binary").toLocalIterator():
        counts[page * _PAGE:(page + 1) * _PAGE] = np.frombuffer(raw, dtype=np.uint8)
    return spokes.sparkSession.sparkContext.broadcast(counts)


def _meeting(spokes: DataFrame, first: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of members of one centre that may be linked; links found on
    the way, of members near a centre with it."""
    comp = first.select("id", "comp")
    told = (spokes.select("centre", "id", "near", "within", F.size("parts").cast("long").alias("size")).join(comp, "id", "left")
            .join(comp.select(F.col("id").alias("centre"), F.col("comp").alias("mid")), "centre", "left")
            .withColumn("comp", F.coalesce("comp", "id")).withColumn("mid", F.coalesce("mid", "centre")))
    told = save(told, "told")
    loose = told.where("near and comp != mid").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), "centre", "comp", "mid")
    known = save(compare(loose.select("a", "b").distinct()), "near").where("linked").select("a", "b")
    # a component with one member linked with the centre goes with it
    tied = loose.join(known, ["a", "b"], "left_semi").select("centre", "comp", F.col("mid").alias("tied")).distinct()
    told = save(told.join(tied, ["centre", "comp"], "left").withColumn("comp", F.coalesce("tied", "comp")).drop("tied"), "told")
    table = _part_counts(spokes)

    def rarest(batches):
        for batch in batches:
            row, part, cell = _cells(batch)
            size = np.bincount(row, minlength=batch.num_rows)
            often = table.value[cell]
            order = np.lexsort((part, often, row))
            row, part, often = row[order], part[order], often[order]
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row] + 1
            need, within = (batch.column(c).to_numpy() for c in ("need", "within"))
            near = batch.column("near").to_numpy(zero_copy_only=False)
            leads = place <= (size - need + 1)[row]
            kept = np.flatnonzero((often > 1) & (leads | (~near & (size <= 2 * within))[row]))
            at = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("centre").take(at), pa.array(part[kept]), batch.column("id").take(at), pa.array(size[row[kept]]),
                 batch.column("near").take(at), batch.column("within").take(at), pa.array(leads[kept]), pa.array((size[row] - place + 1)[kept])],
                names=["centre", "part", "id", "size", "near", "within", "leads", "rest"])
    each = save(spokes.select("centre", "id", "parts", "near", "need", "within").mapInArrow(
        rarest, "centre long, part long, id long, size long, near boolean, within long, leads boolean, rest long")
                .join(told.select("centre", "id", "comp"), ["centre", "id"]), "each")
    table.destroy()
    left = each.where("leads").select("centre", "part", *[F.col(c).alias(f"{c}_i") for c in ("id", "comp", "size", "near", "within", "rest")])
    right = each.select("centre", "part", *[F.col(c).alias(f"{c}_j") for c in ("id", "comp", "size", "near", "within", "leads", "rest")])
    # at the first part that two members share, in order, enough must be left
    within = F.least("within_i", "within_j")
    alike = ((F.col("comp_i") != F.col("comp_j")) & (F.abs(F.col("size_i") - F.col("size_j")) <= within)
             & (2 * F.least("rest_i", "rest_j") >= F.col("size_i") + F.col("size_j") - within)
             & (F.col("near_i") & ~F.col("near_j") | (F.col("near_i") == F.col("near_j")) & F.col("leads_j") & (F.col("id_i") < F.col("id_j"))))
    met = left.join(right, ["centre", "part"]).where(alike).select(F.col("id_i").alias("i"), F.col("id_j").alias("j"))
    # near members that need not share a part
    slim = told.where("near")
    few = (slim.where("comp != mid").select("centre", *[F.col(c).alias(f"{c}_i") for c in ("id", "comp", "size", "within")])
           .join(slim.select("centre", *[F.col(c).alias(f"{c}_j") for c in ("id", "comp", "size", "within")]), "centre")
           .where(F.col("comp_i") != F.col("comp_j")).where(F.col("size_i") + F.col("size_j") <= within)
           .select(F.col("id_i").alias("i"), F.col("id_j").alias("j")))
    met = save(met.unionByName(few).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct(), "met")
    discard(each)
    return met, known
