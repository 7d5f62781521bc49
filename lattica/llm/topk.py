"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import table

#: Candidate rows and query rows of one tile, and the queries multiplied at once in it.
TILE_ROWS, TILE_QUERIES, STRIP = 8192, 2048, 128
#: Tile lists of one query that one merge step takes together.
FAN_IN = 64


def usable(vector: Column, nonzero: bool = False) -> Column:
    """True where vector is neither null nor empty and holds finite numbers only."""
    fine = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if nonzero:
        fine = fine & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component x, taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def top_lists(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of scores, the positions of its k best candidates: score falling, then id rising.

    ids must rise, and may repeat; own holds each row's own id, which never counts.
    """
    n = scores.shape[1]
    more = k + np.searchsorted(ids, own, "right") - np.searchsorted(ids, own, "left")
    for row, me, m in zip(scores, own, more, strict=True):
        if n > m:
            least = np.partition(row, n - m)[n - m]
            at = np.flatnonzero(row >= least)  # all ties at the border
        else:
            at = np.arange(n)
        at = at[ids[at] != me]
        yield at[np.argsort(-row[at], kind="stable")][:k]


def _tile(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "shard": "int32"})
        rows, shard = rows.sort_values("vec_id"), key[1]
        ids, q_ids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        a, b = np.stack(queries["query_v"].to_numpy()), np.stack(rows["row_v"].to_numpy())
        # doubles carry whole numbers below 2**53 exactly; beyond that, products of long integers
        if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
            a, b = a.astype(np.float64), b.astype(np.float64)
        out_q, out_v, out_s = [], [], []
        for i in range(0, len(a), STRIP):
            scores = a[i : i + STRIP] @ b.T
            for j, at in enumerate(top_lists(scores, ids, q_ids[i : i + STRIP], k)):
                out_q.append(np.full(len(at), q_ids[i + j]))
                out_v.append(ids[at])
                out_s.append(scores[j, at].astype(np.int64))
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s), "shard": np.int32(shard)})

    return run


def merge_top(lists: DataFrame, k: int, shards: int) -> DataFrame:
    """Merge the tiles' lists (query_id, vec_id, score, shard) by a tree of FAN_IN, to ranks 1 to k.

    Each level ranks inside (query, group of shards); Spark cuts the lists to k before the exchange.
    """
    best = [F.desc("score"), F.asc("vec_id")]
    while shards > FAN_IN:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        w = Window.partitionBy("query_id", "shard").orderBy(*best)
        lists = lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")
        shards = -(-shards // FAN_IN)
    w = Window.partitionBy("query_id").orderBy(*best)
    return lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """The k rows of largest integer inner product for each query.

    queries(query_id long, v array<long>), rows(vec_id long, v array<long>).  As in OP5_SQL, each repeated row is a
    candidate of its own, and the rows of one query_id share its k ranks.
    Returns query_id, rank (from 1), vec_id, score.  A row whose id equals the query's is not its
    candidate; ties go to the smaller vec_id; vectors of different lengths do not meet; null vectors
    must be filtered out before (see usable).  Empty inputs give no rows.

    Each tile is one task group of at most about TILE_QUERIES x TILE_ROWS vectors.  Queries go to
    every shard of rows and rows to every block of queries: the stated query set against all rows.
    """
    n_rows, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // TILE_ROWS)), max(1, -(-n_queries // TILE_QUERIES))
    q = queries.select("query_id", F.col("v").alias("query_v"), F.size("v").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    r = rows.select("vec_id", F.col("v").alias("row_v"), F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ("block", "shard", "dim")
    lists = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(_tile(k), "query_id long, vec_id long, score long, shard int")
    return merge_top(lists, k, shards)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 20 highest integer inner products over all embeddings."""
    e = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", quantised(F.col("embedding")).alias("v"))
    return exact_top_k(e.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), e, 20)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM e q JOIN e r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v)
  WHERE q.vec_id % 20 = 0
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
