"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one node that keeps its smallest ids.  Nearness is the inner product; for graphs it
becomes a distance: a node gets one more component that brings all of a shard to one length, a query
gets 0 there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, table
from lattica.llm.topk import usable

#: Nodes of one shard's graph and queries of one search task.
SHARD_NODES, TASK_QUERIES = 8192, 2048
#: Out-degree, beam when building and when searching, pruning factors of the two building passes.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHAS = 32, 48, 192, (1.0, 1.2)
BATCH = 256
INDEXED = "shard long, node int, ids array<long>, v array<double>, start boolean, links array<int>"


def beam_search(x: np.ndarray, norms: np.ndarray, links: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Greedy searches of all queries q in step: the beam's nodes and distances, nearest first, and the
    node that each query expanded in each step (-1: none).

    links has -1 where a node has fewer neighbours; distances leave out the query's own length.
    """
    n = len(q)
    rows = np.arange(n)[:, None]
    nodes = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf)
    done = np.ones((n, beam), bool)
    nodes[:, 0], dist[:, 0], done[:, 0] = start, norms[start] - 2 * q @ x[start], False
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    expanded = []
    while True:
        open_ = np.where(done, np.inf, dist)
        at = open_.argmin(1)
        live = np.flatnonzero(np.isfinite(open_[np.arange(n), at]))
        if not len(live):
            return nodes, dist, expanded
        now = nodes[live, at[live]]
        done[live, at[live]] = True
        step = np.full(n, -1)
        step[live] = now
        expanded.append(step)
        near = links[now]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, now[:, None])] = True
        d = np.where(fresh, norms[near] - 2 * np.einsum("ij,ikj->ik", q[live], x[near]), np.inf)
        all_n, all_d = np.concatenate((nodes[live], near), 1), np.concatenate((dist[live], d), 1)
        all_done = np.concatenate((done[live], ~fresh), 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        r = rows[: len(live)]
        nodes[live], dist[live], done[live] = all_n[r, keep], all_d[r, keep], all_done[r, keep]


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Up to degree diverse neighbours of each point: again and again the nearest candidate left, which
    strikes out those that are alpha times nearer to it than to the point.  Candidates may be -1 or repeat."""
    n = len(points)
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == points[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    # the good ones to the front, so that no column has bad ones only
    by = np.argsort(bad, axis=1, kind="stable")[:, : max(1, int((~bad).sum(1).max(initial=0)))]
    candidates, bad = np.take_along_axis(candidates, by, 1), np.take_along_axis(bad, by, 1)
    c = x[candidates]
    own = np.square(c).sum(2)
    d = own + np.square(x[points]).sum(1)[:, None] - 2 * np.matmul(c, x[points][:, :, None])[:, :, 0]
    d = np.where(bad, np.inf, np.maximum(0, d))
    # one product of all candidates gives every distance that strikes out another
    between = own[:, :, None] + own[:, None, :] - 2 * np.matmul(c, c.transpose(0, 2, 1))
    struck = alpha * alpha * np.maximum(0, between) <= d[:, None, :]
    left = d.copy()
    out = np.full((n, degree), -1)
    r = np.arange(n)
    for k in range(degree):
        best = left.argmin(1)
        live = np.isfinite(left[r, best])
        if not live.any():
            break
        out[live, k] = candidates[r, best][live]
        left[struck[r, best]] = np.inf
        left[r, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 1) -> tuple[np.ndarray, int]:
    """The links of each row of x (-1: none) and the node that searches start from."""
    n = len(x)
    rng = np.random.default_rng(seed)
    norms = np.square(x).sum(1)
    start = int(np.argmin(norms - 2 * x @ x.mean(0)))
    links = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1)
    links[links == np.arange(n)[:, None]] = -1
    for alpha in ALPHAS:
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            p = order[i : i + BATCH]
            nodes, _, expanded = beam_search(x, norms, links, start, x[p], beam)
            links[p] = robust_prune(x, p, np.concatenate((nodes, np.stack(expanded, 1), links[p]), 1), alpha, degree)
            # each neighbour gets a link back; those with too many are pruned
            to, back = links[p].ravel(), np.repeat(p, degree)
            back, to = back[to >= 0], to[to >= 0]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            extra = np.full((len(targets), int(count.max(initial=0))), -1)
            extra[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(first, count)] = back
            wide = np.concatenate((links[targets], extra), 1)
            for j in range(0, len(targets), BATCH):
                w = wide[j : j + BATCH]
                links[targets[j : j + BATCH]] = robust_prune(x, targets[j : j + BATCH], w, alpha, degree)
    return links, start


def lifted(v: np.ndarray) -> np.ndarray:
    """Rows with one more component that brings them all to the length of the longest."""
    n = np.square(v).sum(1)
    return np.concatenate((v, np.sqrt(np.maximum(0, n.max() - n))[:, None]), 1)


def _index(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
    d = d.sort_values("first_id").reset_index(drop=True)
    links, start = build(lifted(np.stack(d["v"].to_numpy())))
    return pd.DataFrame({"shard": key[0], "node": d.index, "ids": d["ids"], "v": d["v"], "start": d.index == start, "links": [x[x >= 0] for x in links]})


def _search(k: int):
    def run(key: tuple, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(q) and len(d):
            d = d.sort_values("node")
            v, ids = np.stack(d["v"].to_numpy()), [np.asarray(x) for x in d["ids"]]
            links = np.full((len(d), max(1, max(map(len, d["links"])))), -1)
            for i, x in enumerate(d["links"]):
                links[i, : len(x)] = x
            x = lifted(v)
            norms, start = np.square(x).sum(1), int(np.flatnonzero(d["start"])[0])
            queries = np.stack(q["query_v"].to_numpy())
            asked = np.concatenate((queries, np.zeros((len(q), 1))), 1)
            for i in range(0, len(q), BATCH):
                nodes, _, _ = beam_search(x, norms, links, start, asked[i : i + BATCH], max(SEARCH_BEAM, k + 1))
                for me, one, found in zip(q["query_id"].to_numpy()[i : i + BATCH], queries[i : i + BATCH], nodes, strict=True):
                    found = found[found >= 0]
                    scores = (v[found] * one).sum(1)
                    some = np.concatenate([ids[n] for n in found])
                    score = np.repeat(scores, [len(ids[n]) for n in found])
                    score, some = score[some != me], some[some != me]
                    best = np.lexsort((some, -score))[:k]
                    out["query_id"].append(np.full(len(best), me))
                    out["vec_id"].append(some[best])
                    out["score"].append(score[best])
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def build_index(rows: DataFrame, k: int = 20) -> DataFrame:
    """A graph for each shard of rows(vec_id long, v array<double>): INDEXED, one row for each node.

    Every distinct (vec_id, v) is indexed, repeated rows once: a node stands for all rows of its vector and has the k + 1 smallest of their ids, all
    that k nearest can need.  Nodes are dealt by a hash of the vector into shards of about SHARD_NODES.
    """
    w = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("vec_id", "v").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    nodes = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("first_id"))
    nodes = cut(nodes, "ann-nodes")
    shards = nodes.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / SHARD_NODES).cast("int").alias("shards"))
    dealt = nodes.withColumn("dim", F.size("v")).join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("first_id"), F.col("shards")).cast("long") + F.col("dim").cast("long") * 2**32)
    return dealt.groupBy("shard").applyInPandas(_index, INDEXED)


def nearest(queries: DataFrame, index: DataFrame, k: int = 20) -> DataFrame:
    """The k nearest found for each of queries(query_id, v): query_id, rank, vec_id, score.

    Every shard's graph is searched for every query.  The score is the inner product of the original
    vectors in double precision; a row is no candidate of a query of its id; ties go to the smaller vec_id.
    Repeated query rows count once; the vectors of one query_id share its k ranks.
    """
    queries = queries.select("query_id", "v").distinct()
    blocks = max(1, -(-queries.count() // TASK_QUERIES))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    shards = index.select("shard", F.size("v").alias("dim")).distinct()
    q = queries.select("query_id", F.col("v").alias("query_v"), F.size("v").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).join(shards, "dim").select("query_id", "query_v", (F.col("shard") + 0).alias("in_shard"), "block")
    d = index.select("shard", "node", "ids", "v", "start", "links", F.explode(every).alias("block"))
    found = q.groupBy("in_shard", "block").cogroup(d.groupBy("shard", "block")).applyInPandas(_search(k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 20 nearest embeddings found by beam search."""
    e = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"), nonzero=True) & F.col("vec_id").isNotNull())
    e = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    index = cut(build_index(e, 20), "ann-index")
    return nearest(e.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id"), index, 20)
