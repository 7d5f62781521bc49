"""Best-fit packing under conflicts: residual-ordered bins with source and duplicate-cluster bitmaps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table

#: Documents that one packing task takes.
SHARD_DOCS = 16384
PACKED = "doc_id long, piece int, bin_id long, slot int, start long, n_tokens long"


def estimated_tokens(text: Column) -> Column:
    """A quarter of the text's bytes, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """The bin of each item (size, source, cluster; cluster -1: none), best fit in the order given.

    A bin takes at most per_source items of a source and one of a cluster.  buckets[r] has the bins with r
    left; bit r of filled is set while it has any.  The search starts at the smallest r that holds the item
    and goes to the next larger one until a bin is compatible; of those with r left, it takes the one that
    changed least recently.  Inside a bucket, bins of the same full sources, and among them those of the
    same clusters, are together, so that an item passes over all that are closed to it at once.
    """
    buckets: list[dict[int, dict[int, dict[int, int]]]] = [{} for _ in range(capacity + 1)]  # full sources, clusters, bin: time
    filled = 0
    planes: list[list[int]] = []  # plane i of a bin: sources that it has more than i times
    clusters: list[int] = []
    out = []
    for now, (size, source, cluster) in enumerate(items):
        s, c = 1 << source, 1 << cluster if cluster >= 0 else 0
        left, found = filled >> size, None
        while left:
            r = size + (left & -left).bit_length() - 1
            for full, same in buckets[r].items():
                if not full & s:
                    for held, bins in same.items():
                        if not held & c:
                            b = next(iter(bins))
                            if found is None or bins[b] < found[0]:
                                found = bins[b], b
            if found:
                break
            left &= left - 1
        if found is None:
            b, r = len(planes), capacity
            planes.append([0] * per_source)
            clusters.append(0)
        else:
            b = found[1]
            same = buckets[r][planes[b][-1]]
            bins = same[clusters[b]]
            del bins[b]
            if not bins:
                del same[clusters[b]]
                if not same:
                    del buckets[r][planes[b][-1]]
                    if not buckets[r]:
                        filled &= ~(1 << r)
        own = planes[b]
        for i in range(per_source):
            if not own[i] & s:
                own[i] |= s
                break
        clusters[b] |= c
        buckets[r - size].setdefault(own[-1], {}).setdefault(clusters[b], {})[b] = now
        filled |= 1 << (r - size)
        out.append(b)
    return out


def _pack(capacity: int, per_source: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        whole = d["size"] // capacity
        rest = d.assign(size=d["size"] - whole * capacity, piece=whole)
        rest = rest[(rest["size"] > 0) | (whole == 0)].sort_values(["size", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
        source = pd.factorize(rest["source"], use_na_sentinel=False)[0]
        cluster = pd.factorize(rest["cluster"])[0]
        often = rest["cluster"].map(rest["cluster"].value_counts()).fillna(0).to_numpy() > 1
        names = {x: i for i, x in enumerate(sorted(set(cluster[often].tolist()) - {-1}))}
        items = [(int(n), int(s), names.get(int(c), -1)) for n, s, c in zip(rest["size"], source, cluster, strict=True)]
        bins = best_fit(items, capacity, per_source)
        rest = rest.assign(bin=bins)
        slots, start = rest.groupby("bin").cumcount(), rest.groupby("bin")["size"].cumsum() - rest["size"]
        n = int(rest["bin"].max()) + 1 if len(rest) else 0
        out = [pd.DataFrame({"doc_id": rest["doc_id"], "piece": rest["piece"], "bin_id": rest["bin"], "slot": slots, "start": start, "n_tokens": rest["size"]})]
        long = d.loc[d.index.repeat(whole)]
        if len(long):  # pieces that fill a bin
            out.append(pd.DataFrame({"doc_id": long["doc_id"], "piece": long.groupby(level=0).cumcount(), "bin_id": range(n, n + len(long)), "slot": 0, "start": 0, "n_tokens": capacity}))
        out = pd.concat(out)
        out["bin_id"] += key[0] << 32
        return out

    return run


def pack_best_fit(docs: DataFrame, capacity: int = 4096, per_source: int = 2, n_tokens: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """Pack docs(doc_id, source, text) into bins of capacity tokens.

    Returns doc_id, piece (from 0), bin_id, slot and start (place in the bin), n_tokens.  A bin holds at most per_source
    pieces of one source (null is a source like others) and one document of each duplicate cluster (by
    default documents of equal text, the same row repeated too; a null cluster never conflicts).
    Documents above capacity are cut into pieces that fill a bin each and one rest.  Empty or null texts
    have size 0 and take a slot without tokens.  No row is left out; an empty table gives no bins.

    Rows are dealt by a hash of all that is known of them into shards of about SHARD_DOCS, packed apart from each other,
    largest first; so bins never cross shards and no group, however large, meets in one task.
    """
    size = estimated_tokens(F.col("text")) if n_tokens is None else n_tokens
    same = F.xxhash64("text", F.octet_length("text")) if cluster is None else cluster
    slim = docs.select("doc_id", "source", size.alias("size"), F.when(F.col("text").isNotNull(), same).cast("string").alias("cluster"))
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pack(capacity, per_source), PACKED)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), capacity=4096, per_source=2)
