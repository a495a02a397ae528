"""Exact top-k search by a Voronoi kNN join (operator 8).

Vectors are grouped by their nearest pivot.  A cell is summed up by its radius
and by the smallest distances of its members to the pivot.  For a query q and a
member x of the cell of pivot p at distance d,
    q.p - |q| d  <=  q.x  <=  q.p + |q| radius,
so the summaries alone give each query a score that its k-th best candidate
reaches at least, and the cells that cannot reach it are left out.  A query is
sent to the cells left; cells and their queries are cut into blocks of bounded
size, and each pair of blocks is solved locally.

Equal vectors are one point that carries its k + 1 smallest ids, which is all
that a top k can show of them, so groups of copies do not swell a cell.

Defined cases: vectors that are null or hold null or non-finite components take
no part; rows that repeat an id with the same vector are one row; vectors of
different lengths are compared as if padded with zeros; ties go to the smaller
id; null ids take no part.  Scores are exact while they stay below 2**53.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscope.llm.store import prepare, save
from crawlscope.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])

SCALE = 256
MAX_PIVOTS = 2048
BLOCK = 4096        # vectors of a cell solved at once
QUERY_BLOCK = 1024  # queries sent to a cell solved at once


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(SCALE * component) of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v")))


def unpack(column, size: int) -> np.ndarray:
    """Matrix of packed vectors (binary, int64), padded to ``size``."""
    out = np.zeros((len(column), size))
    for i, raw in enumerate(column):
        row = np.frombuffer(raw, dtype="<i8")
        out[i, :len(row)] = row
    return out


def _assign(pivots: np.ndarray):
    """(ids, v) -> (cell, distance to its pivot, ids, packed v)."""
    norms = (pivots ** 2).sum(axis=1)

    def run(batches):
        for batch in batches:
            lists = batch.column("v").to_pylist()
            raw = [np.asarray(v, dtype="<i8").tobytes() for v in lists]
            x = unpack(raw, pivots.shape[1])
            cell = np.argmin(norms - 2 * x @ pivots.T, axis=1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), batch.column("ids"), pa.array(raw, pa.binary())],
                                             names=["cell", "far", "ids", "v"])
    return run


def search(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best vectors of each row of
    ``vectors`` (vec_id, embedding) that ``is_query`` admits."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = quantised(vectors)
    order = Window.partitionBy("v").orderBy("vec_id")
    points = (rows.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
              .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    points = save(points, "points")
    n, size = points.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = points.orderBy(F.xxhash64("v"), "v").limit(max(1, min(MAX_PIVOTS, math.isqrt(n)))).collect()
    pivots = np.zeros((len(chosen), max(1, size)))
    for i, r in enumerate(chosen):
        pivots[i, :len(r.v)] = r.v
    cells = save(points.mapInArrow(_assign(pivots), "cell int, far double, ids array<long>, v binary"), "cells")

    near = (cells.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("far", "v"))).where(F.col("place") <= k + 1)
            .groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near")))
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(near, "cell").collect()
    at = np.array([r.cell for r in summary])
    radius = np.array([r.radius for r in summary])
    closest = np.full((len(summary), k + 1), np.inf)
    for i, r in enumerate(summary):
        closest[i, :len(r.near)] = r.near
    blocks = {r.cell: -(-r.n // BLOCK) for r in summary}
    n_blocks = np.array([blocks[c] for c in at], dtype=np.int32)
    centre = pivots[at]

    def send(batches):
        for batch in batches:
            raw = [np.asarray(v, dtype="<i8").tobytes() for v in batch.column("v").to_pylist()]
            q = unpack(raw, pivots.shape[1])
            length = np.sqrt((q ** 2).sum(axis=1))
            middle = q @ centre.T
            query, cell, block = [], [], []
            for i in range(len(q)):
                sure = (middle[i][:, None] - length[i] * closest).ravel()
                sure = np.sort(sure[np.isfinite(sure)])[::-1]
                least = sure[k] if len(sure) > k else -np.inf  # one of the k + 1 may be the query itself
                slack = 1e-6 * (1 + abs(middle[i]) + length[i] * radius)
                for j in np.flatnonzero(middle[i] + length[i] * radius + slack >= least):
                    for b in range(n_blocks[j]):
                        query.append(i)
                        cell.append(at[j])
                        block.append(b)
            index = pa.array(query, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(index), pa.array(raw, pa.binary()).take(index),
                                              pa.array(cell, pa.int32()), pa.array(block, pa.int32())], names=["query_id", "q", "cell", "block"])

    queries = rows.where(is_query).distinct()
    sent = save(queries.mapInArrow(send, "query_id long, q binary, cell int, block int"), "sent")
    asked = {r.cell: r.n for r in sent.where("block = 0").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    layout = spark.createDataFrame([(int(c), int(blocks[c]), -(-n // QUERY_BLOCK)) for c, n in asked.items()],
                                   "cell int, blocks int, parts int")  # MAX_PIVOTS rows at most
    sent = sent.join(F.broadcast(layout), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("blocks", "parts")
    data = (cells.join(F.broadcast(layout), "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts"))
    width = pivots.shape[1]

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        score = unpack(q["q"], width) @ unpack(x["v"], width).T
        first = np.array([ids[0] for ids in x["ids"]])
        out = []
        for i, query in enumerate(q["query_id"]):
            edge = -np.partition(-score[i], min(k, len(x) - 1))[min(k, len(x) - 1)]
            top = np.flatnonzero(score[i] >= edge)
            top = top[np.lexsort((first[top], -score[i][top]))][:k + 1]
            found = sorted((-int(score[i][j]), int(v)) for j in top for v in x["ids"].iloc[j] if v != query)[:k]
            out += [(query, v, -s) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["cell", "block", "part"]
    found = sent.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over the whole ``embeddings`` table: every vec_id divisible
    by 50 is a query against all rows."""
    from crawlscope.sources.tables import load

    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = r"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id query_id, b.vec_id, cast(list_inner_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id != b.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank, vec_id, score from p
qualify rank <= 5
"""
