"""N-gram Jaccard join: components of documents whose shingle sets overlap by a T-occurrence search.

1. One pass makes each document's shingle set and a hash of it, its class; equal sets are one class from then on.
2. A class links to another only if no more than a quarter of its shingles are its own.  All shingles whose
   hash falls in a fixed share of the hash space are dealt by hash and counted; classes with too
   many of their own there are out.  For the rest, all shingles are counted the same way.
3. What is left is linked by the shared shingles of its prefixes, rarest first: two sets that reach the overlap share one.
   The components of that are candidate clusters; no link crosses two.
4. Inside a cluster, DivideSkip: merge the short inverted lists of a set, binary-probe the long ones for the
   candidates that can still reach the overlap.  Clusters of more than CLUSTER classes or CLUSTER_SHINGLES shingles are
   searched in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, freed, parts_for, released, small_batches, table
from lattica.llm.components import connected_components
from lattica.llm.shingles import set_id, shingle_sets

#: Share of the hash space that the first count looks at, in eighths.
EIGHTHS = 3
#: Shingles of one counting task, about.
BUCKET_ROWS = 3_000_000
#: Classes and shingles that one search task takes; larger clusters are searched in blocks of half of either after PIVOTS.
CLUSTER, CLUSTER_SHINGLES, PIVOTS = 1024, 4_000_000, 16
#: Bytes of text hashed at once.
CHUNK = 1 << 19
SIGNED = "bucket int, doc_id long, text_hash long, n int, m int, cid long, blob binary"


def enough(n: int) -> int:
    """The least overlap with any set that links: three quarters of n."""
    return -(-3 * n // 4)


def text_hash(text: Column) -> Column:
    """A signed 64-bit hash of a text, of null too."""
    return F.xxhash64(text)


def _chunks(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(t) > CHUNK:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _blobs(hashes: np.ndarray, owner: np.ndarray, cids: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rows (bucket, blob) of hashes and the classes they are of."""
    to = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    hashes, owner, to = hashes[order], owner[order], to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    rows, names = [], []
    for h, o in zip(np.split(hashes, cuts), np.split(owner, cuts), strict=True):
        used, local = np.unique(o, return_inverse=True)
        rows.append(np.array([len(h), len(used)], "<u4").tobytes() + cids[used].tobytes() + h.tobytes() + local.astype("<u4").tobytes())
    names = to[np.concatenate(([0], cuts))] if len(to) else []
    return pd.DataFrame({"bucket": names, "blob": rows if len(to) else []})


def _unblob(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, cids = [], []
    for b in blobs:
        n, k = (int(x) for x in np.frombuffer(b, "<u4", 2))
        names = np.frombuffer(b, "<i8", k, 8)
        hashes.append(np.frombuffer(b, "<u8", n, 8 + 8 * k))
        cids.append(names[np.frombuffer(b, "<u4", n, 8 + 8 * k + 8 * n)])
    return np.concatenate(hashes), np.concatenate(cids)


def _sign(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    border = np.uint64(EIGHTHS << 61)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, m, cid, hashes, owner, seen = [], [], [], [], [], set()
            for at, texts in _chunks(b["text"].tolist()):
                for i, s in enumerate(shingle_sets(texts)):
                    c, part = set_id(s), s[: np.searchsorted(s, border)]
                    n.append(len(s))
                    m.append(len(part))
                    cid.append(c)
                    if c not in seen:
                        seen.add(c)
                        hashes.append(part)
                        owner.append(np.full(len(part), at + i, np.uint32))
            docs = pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "n": n, "m": m, "cid": cid})
            packed = _blobs(np.concatenate(hashes), np.concatenate(owner), np.array(cid, "<i8"), buckets) if hashes else None
            for f in (docs, packed):
                if f is not None and len(f):
                    yield f.reindex(columns=["bucket", "doc_id", "text_hash", "n", "m", "cid", "blob"]).astype({c: "Int64" for c in ("bucket", "doc_id", "text_hash", "n", "m", "cid")})
        released()

    return run


def _runs(blobs: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, their classes, and start and number of distinct classes (2: two or more) of each run."""
    hashes, cids = _unblob(blobs.tolist())
    order = np.argsort(hashes)
    hashes, cids = hashes[order], cids[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(hashes)) + 1)) if len(hashes) else np.zeros(0, np.int64)
    many = np.maximum.reduceat(cids, starts) != np.minimum.reduceat(cids, starts) if len(hashes) else np.zeros(0, bool)
    return hashes, cids, starts, many


def _count_shared(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
    hashes, cids, starts, many = _runs(d["blob"])
    sizes = np.diff(np.append(starts, len(hashes)))
    # a copy met in several batches counts once
    rows = pd.DataFrame({"cid": cids[np.repeat(many, sizes)], "h": hashes[np.repeat(many, sizes)]}).drop_duplicates()
    out = rows.groupby("cid").size()
    del hashes, cids, starts, many, rows
    released()
    return pd.DataFrame({"cid": out.index, "shared": out.to_numpy()})


def _all_shingles(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            want, hashes, owner = b["cid"].to_numpy(), [], []
            for at, texts in _chunks(b["text"].tolist()):
                for i, s in enumerate(shingle_sets(texts)):
                    if set_id(s) == want[at + i]:
                        hashes.append(s)
                        owner.append(np.full(len(s), at + i, np.uint32))
            if hashes:
                yield _blobs(np.concatenate(hashes), np.concatenate(owner), want.astype("<i8"), buckets)
        released()

    return run


def _shared_shingles(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
    """For each class, its shingles of the bucket that other classes have too, and how many have them."""
    hashes, cids, starts, many = _runs(d["blob"])
    sizes = np.diff(np.append(starts, len(hashes)))
    keep = np.repeat(many, sizes)
    rows = pd.DataFrame({"cid": cids[keep], "h": hashes[keep]}).drop_duplicates()
    rows["f"] = rows.groupby("h")["cid"].transform("size")
    rows = rows.sort_values("cid", kind="stable")
    c = rows["cid"].to_numpy()
    cuts = np.flatnonzero(np.diff(c)) + 1
    h, f = np.split(rows["h"].to_numpy(), cuts), np.split(rows["f"].to_numpy().astype("<u4"), cuts)
    if not len(c):
        return pd.DataFrame({"cid": np.zeros(0, np.int64), "shared": np.zeros(0, np.int64), "blob": []})
    del hashes, cids, starts, many, keep, rows
    released()
    return pd.DataFrame({"cid": c[np.concatenate(([0], cuts))], "shared": [len(x) for x in h], "blob": [x.tobytes() + y.tobytes() for x, y in zip(h, f, strict=True)]})


def _prefix(d: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each class's shared shingles, rarest first, and the part of them that is in its prefix."""
    sets, prefixes = [], []
    for n, blobs in zip(d["n"], d["blobs"], strict=True):
        h = np.concatenate([np.frombuffer(x, "<u8", len(x) // 12) for x in blobs])
        f = np.concatenate([np.frombuffer(x, "<u4", len(x) // 12, len(x) // 12 * 8) for x in blobs])
        h = h[np.lexsort((h, f))]
        sets.append(h)
        prefixes.append(h[: max(0, len(h) - enough(int(n)) + 1)])
    return sets, prefixes


def _prefix_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        _, p = _prefix(b)
        yield pd.DataFrame({"key": np.concatenate(p).astype(np.int64), "cid": np.repeat(b["cid"].to_numpy(), [len(x) for x in p])})


# ---------------------------------------------------------------- the search in one cluster or cell


def divide_skip(probes: list[np.ndarray], probe_n: np.ndarray, rows: list[np.ndarray], row_n: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links (probe, row) that connect all probes and rows whose overlap reaches the threshold.

    With same, probes are the rows, and each looks at those before it.  Links inside a component that
    earlier links made are passed over; no component is missed.
    """
    hashes = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]  # the inverted lists, one after the other
    starts = np.concatenate(([0], np.flatnonzero(np.diff(hashes)) + 1)) if len(hashes) else np.zeros(0, np.int64)
    keys, ends = hashes[starts], np.append(starts[1:], len(hashes))
    label = np.arange(len(rows) + (0 if same else len(probes)))
    links = []
    for i, s in enumerate(probes):
        me, n = (i if same else len(rows) + i), int(probe_n[i])
        at = np.searchsorted(keys, s)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == s)] if len(keys) else at[:0]
        least = enough(n)
        if len(at) < least:
            continue
        lengths = ends[at] - starts[at]
        at = at[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        n_long = min(least - 1, max(0, int(least / (0.01 * math.log2(longest + 1) + 1))))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        found, count = np.unique(np.concatenate([owner[starts[a] : ends[a]] for a in short]), return_counts=True)
        fit = (count >= least - n_long) & (4 * row_n[found] >= 3 * n) & (3 * row_n[found] <= 4 * n)
        if same:
            fit &= found < i
        found, count = found[fit], count[fit]
        rank = np.argsort(-count, kind="stable")
        found, count = found[rank], count[rank]
        step = 4
        while True:
            open_ = label[found] != label[me]
            found, count = found[open_], count[open_]
            if not len(found):
                break
            some, overlap = found[:step], count[:step].copy()
            for a in long:
                own = owner[starts[a] : ends[a]]
                place = np.searchsorted(own, some)
                overlap += (place < len(own)) & (own[np.minimum(place, len(own) - 1)] == some)
            for r in some[7 * overlap >= 3 * (n + row_n[some])].tolist():
                if label[r] != label[me]:
                    links.append((i, r))
                    label[label == label[r]] = label[me]
            found, count, step = found[step:], count[step:], min(4096, step * 4)
    return links


def _links(links: list[tuple[int, int]], a: pd.Series, b: pd.Series) -> pd.DataFrame:
    x, y = (np.array([p[i] for p in links], dtype=np.int64) for i in (0, 1))
    return pd.DataFrame({"a": a.to_numpy()[x] if len(x) else x, "b": b.to_numpy()[y] if len(y) else y})


def _search_cluster(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
    d = d.sort_values(["n", "cid"])
    s, n = _prefix(d)[0], d["n"].to_numpy()
    out = _links(divide_skip(s, n, s, n, True), d["cid"], d["cid"])
    del s, d
    released()
    return out


def _search_cell(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    if a.empty or b.empty:
        return _links([], pd.Series(dtype="int64"), pd.Series(dtype="int64"))
    a, b = a.sort_values("a_cid"), b.sort_values("b_cid")
    pa, pb = (x.rename(columns={f"{p}_n": "n", f"{p}_blobs": "blobs"}) for p, x in (("a", a), ("b", b)))
    return _links(divide_skip(_prefix(pa)[0], pa["n"].to_numpy(), _prefix(pb)[0], pb["n"].to_numpy(), False), a["a_cid"], b["b_cid"])


def _cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Links between rows of a and b (cell columns cluster, i, j; cid, n, blobs) of the same cell."""
    keys = ["cluster", "i", "j"]
    x, y = (f.select(*(F.col(c).alias(f"{p}_{c}") for c in (*keys, "cid", "n", "blobs"))) for p, f in (("a", a), ("b", b)))
    return x.groupBy(*(f"a_{k}" for k in keys)).cogroup(y.groupBy(*(f"b_{k}" for k in keys))).applyInPandas(_search_cell, "a long, b long")


def _search_large(large: DataFrame, done: DataFrame) -> DataFrame:
    """Links of clusters above the bounds: large has cluster, size, shingles, cid, n, blobs.

    A few classes of each cluster, its pivots, are compared with all of it; then every class outside
    the largest component that this makes is compared with every class, in cells of a block by a block.
    """
    blocks = F.ceil(F.greatest(2 * F.col("size") / CLUSTER, 2 * F.col("shingles") / CLUSTER_SHINGLES)).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    w = Window.partitionBy("cluster").orderBy(F.xxhash64("cid", F.lit(1)), "cid")
    pivots = dealt.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= PIVOTS)
    pivots = pivots.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = cut(done.unionByName(_cells(dealt.withColumn("j", F.lit(0)), pivots.withColumn("j", F.lit(0)))), "jaccard-pivots")
    labels = connected_components(links)
    known = dealt.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    sizes = known.groupBy("cluster", "label").count()
    main = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    outside = known.join(main, "cluster").filter("label <> main").drop("main", "label")
    rows = dealt.withColumn("j", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    probes = outside.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return links.unionByName(_cells(probes, rows))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Components of docs(doc_id long, text) linked by a shingle Jaccard similarity of 0.75 or more.

    Returns doc_id, n_shingles, component_id: one row for each row.  component_id is the smallest doc_id reachable by
    links, its own where there is none.  Texts that are null or without words have no shingles and link
    with nothing.  Repeated rows and equal texts have equal sets, so they link; rows of one doc_id with different
    texts count as documents of their own.  A null doc_id takes part, but is never a component's smallest
    unless all of it are null.  Sets are of 64-bit hashes: all documents, whole texts.
    """
    return jaccard_rows(docs).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame) -> DataFrame:
    """jaccard_components() with two more columns: text_hash, which is text_hash() of the row's text, and label, the
    component's own name, null for a row without shingles; doc_ids don't tell components apart where they repeat."""
    small_batches(docs.sparkSession)
    shingles = parts_for(docs, "text", 6) * 1_000_000
    buckets = max(8, -(-shingles * EIGHTHS // 8 // BUCKET_ROWS))
    signed = cut(docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash")).mapInPandas(_sign(buckets), SIGNED), "jaccard-signed")
    rows = cut(signed.filter("bucket IS NULL").select("doc_id", "text_hash", "n", "m", "cid"), "jaccard-rows")
    # one row of a class, by id and text, gives its text
    one = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("mark")
    classes = cut(rows.filter("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.min("doc_id").alias("rep"), one), "jaccard-classes")
    shared = signed.filter("bucket IS NOT NULL").select("bucket", "blob").groupBy("bucket").applyInPandas(_count_shared, "cid long, shared long").groupBy("cid").agg(F.sum("shared").alias("shared"))
    active = classes.join(shared, "cid", "left").filter("m - coalesce(shared, 0) <= n div 4").select("cid", "n", "rep", "mark")
    active = cut(active, "jaccard-active")
    freed(signed)
    named = [F.coalesce("rep", F.lit(0)).alias("_id"), F.col("rep").isNull().alias("_null"), "mark"]
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), text_hash(F.col("text")).alias("mark"), "text")
    texts = texts.join(active.select("cid", *named).hint("merge"), ["_id", "_null", "mark"]).dropDuplicates(["_id", "_null", "mark"]).select("cid", "text")
    full = max(8, -(-(active.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS))
    dealt = texts.mapInPandas(_all_shingles(full), "bucket int, blob binary")
    pieces = cut(dealt.groupBy("bucket").applyInPandas(_shared_shingles, "cid long, shared long, blob binary"), "jaccard-shared")
    left = pieces.groupBy("cid").agg(F.sum("shared").alias("shared")).join(active.select("cid", "n"), "cid").filter("4 * shared >= 3 * n").select("cid", "n")
    sets = cut(pieces.join(left, "cid").groupBy("cid", "n").agg(F.collect_list("blob").alias("blobs")), "jaccard-sets")
    keys = cut(sets.mapInPandas(_prefix_keys, "key long, cid long"), "jaccard-keys")
    hubs = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("top")).filter("hub <> top")
    clusters = connected_components(keys.join(hubs, "key").select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    clusters = clusters.select(F.col("node").alias("cid"), F.col("label").alias("cluster"))
    clusters = clusters.join(sets.select("cid", "n"), "cid")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    members = cut(sets.join(clusters.drop("n").join(sizes, "cluster"), "cid"), "jaccard-members")
    small = (F.col("size") <= CLUSTER) & (F.col("shingles") <= CLUSTER_SHINGLES)
    links = cut(members.filter(small).select("cluster", "cid", "n", "blobs").groupBy("cluster").applyInPandas(_search_cluster, "a long, b long"), "jaccard-links")
    large = members.filter(~small)
    if not large.isEmpty():
        links = cut(_search_large(large, links), "jaccard-links")
    labels = connected_components(links)
    joined = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "rep", F.coalesce("label", "cid").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = cut(joined.join(smallest, "label").select("cid", "label", "component_id"), "jaccard-components")
    freed(classes, active, pieces, sets, keys, members, links)
    out = rows.join(found, "cid", "left")
    return out.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT s.doc_id, s.s, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY c.c, s.s) AS r
  FROM s JOIN n USING (doc_id) JOIN (SELECT s, count(*) AS c FROM s GROUP BY s) c ON c.s = s.s),
p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
  FROM f a JOIN f b ON a.s = b.s AND a.doc_id < b.doc_id AND a.r <= a.n - ceil(0.75 * a.n) + 1 AND b.r <= b.n - ceil(0.75 * b.n) + 1
  WHERE 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n),
o AS (SELECT a, b, count(*) AS o FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, na, nb HAVING 100 * count(*) >= 75 * (na + nb - count(*))),
e AS (SELECT a AS u, b AS v FROM o UNION ALL SELECT b, a FROM o),
r AS (
  WITH RECURSIVE t(u, v) AS (SELECT u, v FROM e UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u) SELECT u, min(v) AS m FROM t GROUP BY u
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(r.m, d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.u = d.doc_id
"""
