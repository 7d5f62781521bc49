"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions, each with a context tree of its own whose contexts are the DEPTH bytes
before it.  A node of a tree has the Krichevsky-Trofimov block probability of the decisions seen in its
context; its weighted probability is half that plus half the product of its children's.  A decision's
probability mixes the estimates of all depths by the weights that this gives.  A text is its
bytes and an end byte (0xFF); before it, end bytes are assumed.  Minus log2 of the probability of a text is its code length in bits.

Documents are dealt into blocks.  A block's distinct (DEPTH + 1)-grams, not its text, go to where
grams are counted; after the trees are weighted, each block gets back the code lengths of its own
grams, so no model is held whole anywhere and none is broadcast, but for the levels of no and one context byte, which
have at most 256 * 255 nodes of 40 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import cut, freed, mix64, parts_for, released, small_batches, table
from lattica.llm.shingles import word_hashes

DEPTH = 5
BLOCK_MB, CHUNK = 24, 1 << 21
END = 0xFF
WORDS, GRAMS = 0, 1
LN_HALF = math.log(0.5)


# ---------------------------------------------------------------- trees


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series after eight steps of the recurrence."""
    y = x + 8.0
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x.copy()
    for i in range(1, 8):
        product *= x + i
    return out - np.log(product)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """Nodes of one depth, for grams (context bytes, nearest first, then the byte; sorted, distinct).

    A node's key is its context and, in the last byte, 1 followed by the bits of the byte so far.
    """

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> None:
        self.keys, self.n0, self.n1 = keys, n0, n1
        self.kt = log_kt(n0, n1)
        self.weighted = self.kt

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> tuple[Level, list[np.ndarray]]:
        """The level and, for each bit, the node of each gram."""
        keys, n0, n1, at = [], [], [], []
        context, byte = grams >> np.uint64(8) << np.uint64(8), grams & np.uint64(0xFF)
        for k in range(8):
            node = context | np.uint64(1 << k) | byte >> np.uint64(8 - k)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1)) if len(node) else np.zeros(0, np.int64)
            bit = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(np.float64)
            keys.append(node[starts])
            n1.append(np.add.reduceat(counts * bit, starts) if len(node) else counts)
            n0.append(np.add.reduceat(counts * (1 - bit), starts) if len(node) else counts)
            at.append(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node)))))
        flat = np.concatenate(keys)
        order = np.argsort(flat)
        rank = np.empty(len(flat), np.int64)
        rank[order] = np.arange(len(flat))
        offset = np.cumsum([0, *map(len, keys)])
        return cls(flat[order], np.concatenate(n0)[order], np.concatenate(n1)[order]), [rank[a + o] for a, o in zip(at, offset, strict=False)]

    def parents(self) -> np.ndarray:
        """Keys of the nodes one byte of context shorter."""
        return self.keys >> np.uint64(16) << np.uint64(8) | self.keys & np.uint64(0xFF)

    def up(self) -> Level:
        """The level above, weighted with this one as its children."""
        keys, at = np.unique(self.parents(), return_inverse=True)
        out = Level(keys, np.bincount(at, self.n0, len(keys)), np.bincount(at, self.n1, len(keys)))
        out.weighted = np.logaddexp(LN_HALF + out.kt, LN_HALF + np.bincount(at, self.weighted, len(keys)))
        return out

    def down(self, above: Level | None) -> None:
        """Set `mixed` (what shallower depths give a one) and `rest` (the weight they leave)."""
        if above is None:
            self.mixed, self.rest = np.zeros(len(self.keys)), np.ones(len(self.keys))
            return
        at = np.searchsorted(above.keys, self.parents())
        own = np.exp(np.minimum(0.0, LN_HALF + above.kt - above.weighted))
        one = (above.n1 + 0.5) / (above.n0 + above.n1 + 1)
        self.mixed = (above.mixed + above.rest * own * one)[at]
        self.rest = (above.rest * (1 - own))[at]


def tree_up(grams: np.ndarray, counts: np.ndarray, depth: int, to: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels depth to `to`, deepest first, and each gram's nodes of the deepest."""
    level, at = Level.of(grams, counts)
    levels = [level]
    for _ in range(depth - to):
        levels.append(levels[-1].up())
    return levels, at


def code_lengths(grams: np.ndarray, levels: list[Level], at: list[np.ndarray]) -> np.ndarray:
    """Bits of each gram's byte in its context; the last of levels must have mixed and rest."""
    for deep, above in zip(levels[-2::-1], levels[:0:-1], strict=True):
        deep.down(above)
    last = levels[0]
    one = last.mixed + last.rest * (last.n1 + 0.5) / (last.n0 + last.n1 + 1)
    bits = np.zeros(len(grams))
    for k in range(8):
        p = one[at[k]]
        bits -= np.log2(np.where(grams >> np.uint64(7 - k) & np.uint64(1), p, 1 - p))
    return bits


def grams_of(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all bytes and ends of the texts, in order, and where each text's begin."""
    pad = bytes([END]) * depth
    b = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
    n = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum([0, *n[:-1]]) if len(n) else np.zeros(0, np.int64)
    g = b.astype(np.uint64)
    for i in range(1, depth + 1):
        g[i:] |= b[:-i].astype(np.uint64) << np.uint64(8 * (depth + 1 - i))
    keep = np.ones(len(b), bool)
    keep[:depth] = False
    ends = depth + starts + (depth - 1) * np.arange(len(n)) + n
    for i in range(depth - 1):
        keep[ends + i] = False
    return g[keep], starts


# ---------------------------------------------------------------- blobs


def _blob(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences, then values."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").tobytes() + values.tobytes()


def _unblob(b: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) // (8 + np.dtype(kind).itemsize)
    return np.cumsum(np.frombuffer(b, "<u8", n), dtype=np.uint64), np.frombuffer(b, kind, n, 8 * n)


def _split(keys: np.ndarray, values: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(target, blob) for each target; keys must be sorted."""
    order = np.argsort(to, kind="stable")
    keys, values, to = keys[order], values[order], to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    if len(to):
        for t, k, v in zip(to[np.concatenate(([0], cuts))].tolist(), np.split(keys, cuts), np.split(values, cuts), strict=True):
            yield t, _blob(k, v)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(buckets)).astype(np.int64)


def _chunks(d: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(row numbers, texts, held out) of about CHUNK bytes."""
    at, texts, size = [], [], 0
    held = d["held_out"].to_numpy(dtype=bool)
    for i, t in enumerate(d["text"].tolist()):
        t = (t or "").encode("utf-8", "surrogatepass")
        at.append(i)
        texts.append(t)
        size += len(t)
        if size >= CHUNK:
            yield np.array(at), texts, held[at]
            at, texts, size = [], [], 0
    if at:
        yield np.array(at), texts, held[at]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts and the sums of their counts."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype("<i8")


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how many of each are in training."""
    seen, n = np.unique(keys[train], return_counts=True)
    other = np.setdiff1d(keys[~train], seen)
    return np.concatenate((seen, other)), np.concatenate((n, np.zeros(len(other), np.int64)))


# ---------------------------------------------------------------- tasks


def _dictionary(buckets: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        words, grams = [], []
        for _, texts, held in _chunks(d):
            w, doc = word_hashes(texts)
            words.append(_distinct(w, ~held[doc]))
            g, starts = grams_of(texts)
            grams.append(_distinct(g, np.repeat(~held, np.diff(np.append(starts, len(g))))))
        rows = [(bucket, kind, blob) for kind, parts in ((WORDS, words), (GRAMS, grams)) for keys, n in [_counted(parts)] for bucket, blob in _split(keys, n, _bucket(keys, buckets))]
        out = pd.DataFrame(rows, columns=["bucket", "kind", "blob"])
        out["block"] = key[0]
        del words, grams, rows
        released()
        return out[["bucket", "block", "kind", "blob"]]

    return run


def _merge_words(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
    own = [_unblob(b, "<i8") for b in d["blob"]]
    keys, n = _counted(own)
    rows = [(block, _blob(k, n[np.searchsorted(keys, k)])) for block, (k, _) in zip(d["block"].tolist(), own, strict=True)]
    out = pd.DataFrame(rows, columns=["block", "blob"])
    out["tokens"] = out["known"] = 0
    out.loc[0, ["tokens", "known"]] = int(n.sum()), int((n > 0).sum())
    out["kind"] = WORDS
    return out[["block", "kind", "blob", "tokens", "known"]]


def _merge_grams(subtrees: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        keys, n = _counted([_unblob(b, "<i8") for b in d["blob"]])
        return pd.DataFrame(_split(keys, n, _bucket(keys >> np.uint64(8 * (DEPTH - 1)), subtrees)), columns=["sub", "blob"])

    return run


def _subtree(d: pd.DataFrame) -> tuple[np.ndarray, list[Level], list[np.ndarray]]:
    grams, n = _counted([_unblob(b, "<i8") for b in d["blob"]])
    return grams, *tree_up(grams, n.astype(np.float64), DEPTH, 2)


def _packed(x: Level) -> bytes:
    return np.concatenate((x.keys.view("<f8"), x.n0, x.n1, x.weighted)).tobytes()


def _unpacked(blobs: list[bytes]) -> Level:
    parts = [np.frombuffer(b, "<f8").reshape(4, -1) for b in blobs]
    keys, n0, n1, weighted = (np.concatenate([p[i] for p in parts]) for i in range(4))
    keys = keys.view("<u8")
    order = np.argsort(keys)
    out = Level(keys[order], n0[order], n1[order])
    out.weighted = weighted[order]
    return out


def _subtree_top(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
    """The nodes of two context bytes, a row for each nearest byte."""
    top = _subtree(d)[1][-1]
    nearest = (top.keys >> np.uint64(56)).astype(np.int64)  # the nearest byte is the highest of a key
    cuts = np.flatnonzero(np.diff(nearest)) + 1
    parts = [Level(k, x, y) for k, x, y in zip(*(np.split(v, cuts) for v in (top.keys, top.n0, top.n1)), strict=True)] if len(nearest) else []
    for part, w in zip(parts, np.split(top.weighted, cuts), strict=False):
        part.weighted = w
    return pd.DataFrame({"nearest": nearest[np.concatenate(([0], cuts)).astype(np.int64)] if parts else [], "blob": [_packed(x) for x in parts]})


def _one_byte(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one context byte: 255 at most, from 65280 at most."""
    return pd.DataFrame({"blob": [_packed(_unpacked(d["blob"].tolist()).up())]})


def _top_model(blobs: list[bytes]) -> Level:
    """The level of one context byte, with what the one above gives it."""
    one = _unpacked(blobs)
    none = one.up()
    none.down(None)
    one.down(none)
    return one


def _unpacked_top(x: tuple[bytes, np.ndarray, np.ndarray]) -> Level:
    one = _unpacked([x[0]])
    one.mixed, one.rest = x[1], x[2]
    return one


def _code_lengths(top, buckets: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        grams, levels, at = _subtree(d)
        levels[-1].down(_unpacked_top(top.value))
        return pd.DataFrame(_split(grams, code_lengths(grams, levels, at).astype("<f4"), _bucket(grams, buckets)), columns=["bucket", "blob"])

    return run


def _route(key: tuple, own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    if own.empty:
        return pd.DataFrame({"block": np.zeros(0, np.int64), "kind": np.zeros(0, np.int64), "blob": []})
    parts = [_unblob(b, "<f4") for b in model["lengths"]]
    keys, bits = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys)
    keys, bits = keys[order], bits[order]
    return pd.DataFrame([(block, GRAMS, _blob(k, bits[np.searchsorted(keys, k)])) for block, b in zip(own["block"].tolist(), own["blob"], strict=True) for k, _ in [_unblob(b, "<i8")]], columns=["block", "kind", "blob"])


def _sums(x: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts))
    full = n > 0
    out[full] = np.add.reduceat(x, starts[full]) if full.any() else 0
    return out


def _score(tokens: int, distinct: int, train_docs: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    whole = tokens + distinct + 1

    def lookup(d: pd.DataFrame, kind: int, form: str) -> tuple[np.ndarray, np.ndarray]:
        parts = [_unblob(b, form) for b in d.loc[d["kind"] == kind, "model"]]
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, form)
        keys, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys)
        return keys[order], values[order]

    def run(key: tuple, d: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if d.empty:
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        (words, word_n), (grams, bits) = lookup(model, WORDS, "<i8"), lookup(model, GRAMS, "<f4")
        logs = np.log10((word_n + 1.0) / whole)
        n_tokens, n_known, base, score = (np.zeros(len(d)) for _ in range(4))
        for at, texts, _ in _chunks(d):
            w, doc = word_hashes(texts)
            n = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
            starts, place = np.cumsum(n) - n, np.searchsorted(words, w)
            n_tokens[at] = n + 1
            n_known[at] = _sums((word_n[place] > 0).astype(float), starts, n) + (train_docs > 0)
            base[at] = _sums(logs[place], starts, n) + math.log10((train_docs + 1) / whole)
            g, starts = grams_of(texts)
            seen, place = np.unique(g, return_inverse=True)
            score[at] = np.add.reduceat(bits[np.searchsorted(grams, seen)][place], starts, dtype=np.float64) * -math.log10(2)
        del words, word_n, grams, bits
        released()
        return pd.DataFrame({"doc_id": d["doc_id"], "held_out": d["held_out"], "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64), "train_tokens": tokens, "base_score": base, "score": score})

    return run


def score_texts(docs: DataFrame, held_out: F.Column | None = None) -> DataFrame:
    """Score every row of docs(doc_id, text) by a model of the rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability by
    context-tree weighting).  A null or empty text is the end alone.  Repeated rows are scored and, in training, counted each.
    held_out is a boolean column, by default crc32(doc_id as text) mod 7 = 2; null counts as false.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2 if held_out is None else held_out
    blocks = parts_for(docs, "text", BLOCK_MB)
    buckets = min(1 << 16, max(8, blocks))  # subtrees: one for each two context bytes at most
    dealt = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    own = cut(dealt.groupBy("block").applyInPandas(_dictionary(buckets), "bucket int, block int, kind int, blob binary"), "ctw-dictionaries")
    words = cut(own.filter(F.col("kind") == WORDS).groupBy("bucket").applyInPandas(_merge_words, "block int, kind int, blob binary, tokens long, known long"), "ctw-words")
    grams = cut(own.filter(F.col("kind") == GRAMS).groupBy("bucket").applyInPandas(_merge_grams(buckets), "sub int, blob binary"), "ctw-grams")
    total = words.agg(F.sum("tokens"), F.sum("known")).first()
    train_docs = docs.filter(~F.coalesce(held, F.lit(False))).count()
    tokens, distinct = (total[0] or 0) + train_docs, (total[1] or 0) + (train_docs > 0)
    two = grams.groupBy("sub").applyInPandas(_subtree_top, "nearest int, blob binary")
    tops = [bytes(r[0]) for r in two.groupBy("nearest").applyInPandas(_one_byte, "blob binary").collect()]  # 256 rows at most
    one = _top_model(tops) if tops else None
    top = spark.sparkContext.broadcast((_packed(one), one.mixed, one.rest) if one else None)
    lengths = grams.groupBy("sub").applyInPandas(_code_lengths(top, buckets), "bucket int, blob binary").withColumnRenamed("blob", "lengths")
    routed = own.filter(F.col("kind") == GRAMS).select("bucket", "block", "blob").groupBy("bucket").cogroup(lengths.groupBy("bucket")).applyInPandas(_route, "block int, kind int, blob binary")
    model = cut(words.select("block", "kind", "blob").unionByName(routed), "ctw-model")
    freed(own, words, grams)
    model = model.select("block", "kind", F.col("blob").alias("model"))
    return dealt.groupBy("block").cogroup(model.groupBy("block")).applyInPandas(_score(tokens, distinct, train_docs), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
