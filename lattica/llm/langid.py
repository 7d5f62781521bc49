"""Language identification by Bayesian evidence fusion.

Evidence of a row: its text, its declared language, the suffix of its address and its host.  The text
gives likelihoods of byte trigrams under each language.  What the other three say is learned from all rows by
grouped aggregation of what the texts alone say: how often each language declares what, how common each
language is at an address suffix, and host priors that fall back from host to domain to all rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import cut, released, small_batches, table, uncarried

#: The classifier is fitted on about so many labelled texts of each language, by a seeded hash, and on every
#: language; rows to identify have no such bound.
FIT_TEXTS = 1000
#: Languages whose counts a fitting task holds before it hands them on.
HELD_LANGUAGES = 64
SLOTS = 1 << 16
CHUNK = 1 << 18
#: Text evidence counts as that of n / (1 + n / FULL) trigrams: neighbours in a text are not independent.
FULL = 400.0
#: Prior rows that a host takes from its domain and a domain from all rows; smoothing of the other tables.
HOST_PRIOR, DOMAIN_PRIOR, SMOOTHING = 10.0, 20.0, 1.0
#: A row is accepted if its language has this probability and its trigrams are not rarer than random ones.
LEAST_PROBABILITY, LEAST_FIT = 0.5, -10.5
VOTE_BYTES = 20
_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of each text, in lower case between two spaces, and where each text's begin."""
    b = np.frombuffer(b" " + b"".join(t + b"  " for t in texts), np.uint8).astype(np.uint32)
    b = np.where((b >= 65) & (b <= 90), b + 32, np.where((b < 32), 32, b)).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)).astype(np.uint32)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    return h, np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]


def _bytes(x: str | None, markup: bool) -> bytes:
    x = x or ""
    return (_TAGS.sub(" ", x) if markup else x).encode("utf-8", "surrogatepass")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pd.DataFrame]:
        for language, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"language": language, "slot": at, "n": n[at]})
        sums.clear()

    for b in batches:
        for language, text in zip(b["language"], b["text"], strict=True):
            if language not in sums:
                if len(sums) >= HELD_LANGUAGES:
                    yield from counted()
                sums[language] = np.zeros(SLOTS, np.int64)
            sums[language] += np.bincount(trigrams([_bytes(text, False)])[0], minlength=SLOTS)
    yield from counted()
    released()


#: For each language: slots of the trigrams that its texts have, their ln probabilities, and that of all others.
Model = list[tuple[np.ndarray, np.ndarray, np.float32]]


def fit(labelled: DataFrame) -> tuple[list[str], Model]:
    """Languages, the most frequent first, and their trigrams, from labelled(doc_id, text, language)."""
    known = labelled.filter("language IS NOT NULL AND language <> '' AND text IS NOT NULL")
    counts = {r["language"]: r["count"] for r in known.groupBy("language").count().orderBy(F.desc("count"), "language").collect()}
    if not counts:
        return [], []
    # a threshold on the hash takes the sample without ordering the rows of a language together
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 40)
    shares = F.create_map(*(F.lit(x) for language, n in counts.items() for x in (language, int(min(1.0, FIT_TEXTS / n) * (1 << 24)))))
    sample = known.filter(rank < shares[F.col("language")])
    # SLOTS rows a language at most
    found = sample.select("language", "text").mapInPandas(_count, "language string, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n")).toPandas()
    by = {x: (g["slot"].to_numpy(np.int64), g["n"].to_numpy(float)) for x, g in found.groupby("language")}
    model = []
    for language in counts:
        at, n = by.get(language, (np.zeros(0, np.int64), np.zeros(0)))
        whole = np.log(n.sum() + 0.1 * SLOTS)
        model.append((at.astype(np.uint16), (np.log(n + 0.1) - whole).astype(np.float32), np.float32(np.log(0.1) - whole)))
    return list(counts), model


def text_evidence(spark: SparkSession, model: Model, markup: bool) -> Callable:
    """A column function: trigrams of the text, then the mean ln likelihood under each language."""
    shared = spark.sparkContext.broadcast(model)  # 6 bytes for each trigram of each language

    def column(j: int) -> np.ndarray:
        at, p, rest = shared.value[j]
        whole = np.full(SLOTS, rest, np.float32)
        whole[at] = p
        return whole

    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, held, size = [], [], 0

            def flush(out: list = out, held: list = held) -> None:
                h, starts = trigrams(held)
                n = np.diff(np.append(starts, len(h)))
                means = np.stack([np.add.reduceat(column(j)[h], starts, dtype=np.float64) for j in range(len(shared.value))], 1) / n[:, None]
                # a text of spaces alone says nothing
                out.extend(np.concatenate((np.array([[len(t) if t.strip() else 0] for t in held], float), means), 1))
                held.clear()

            for t in texts:
                held.append(_bytes(t, markup))
                size += len(held[-1])
                if size > CHUNK:
                    flush()
                    size = 0
            if held:
                flush()
            yield pd.Series(out)
        released()

    return evidence


def _argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int")


def _distribution(counts: Column, prior: Column, weight: float) -> Column:
    """Counts smoothed by weight prior rows."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda n, p: (n + F.lit(weight) * p) / (total + F.lit(weight)))


def identify(rows: DataFrame, languages: list[str], model: Model, text: str, declared: Column, host: Column, domain: Column, suffix: Column, markup: bool = False) -> DataFrame:
    """rows with columns language, probability, text_language and accepted.

    declared, host, domain and suffix may be null: no evidence.  language is null, probability 0 and the row not
    accepted where the text has no characters but space; other evidence alone is not enough.  Otherwise
    accepted means: probability at least LEAST_PROBABILITY and mean ln likelihood of the text's
    trigrams at least LEAST_FIT.  Ties go to the language more frequent in the labelled texts.  Columns of rows stay as they are, but for those of
    the added names, which are replaced.  What hosts, suffixes and declared languages say is learned from all
    texts of VOTE_BYTES bytes or more; shorter ones are identified like others, but their own language is too unsure to teach.

    Texts are read twice and never written: once for the votes, once for the result.  Votes become one table of
    what each (declared, host, domain, suffix) says, which is joined to the texts by one key; where Spark
    can't broadcast it, a hot host is one skewed key of one join, which adaptive execution splits.
    """
    small_batches(rows.sparkSession)
    n = len(languages)
    found = {"_lid_" + k: c for k, c in (("declared", F.lower(declared)), ("host", F.lower(host)), ("domain", F.lower(domain)), ("suffix", F.lower(suffix)))}
    columns, marks = rows.columns, list(found)
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.col(text).alias("_lid_input"), *(c.alias(k) for k, c in found.items()))
    if not n:
        none = F.lit(None).cast("string")
        return uncarried(rows, columns, (), {"language": none, "probability": F.lit(0.0), "text_language": none, "accepted": F.lit(False)})
    names = F.array(*(F.lit(x) for x in languages))
    seen = rows.withColumn("_lid_text", text_evidence(rows.sparkSession, model, markup)(F.col("_lid_input"))).drop("_lid_input")
    size = F.element_at("_lid_text", 1)
    means = F.slice("_lid_text", 2, n)
    votes = seen.select(F.when(size >= VOTE_BYTES, _argmax(means)).alias("vote"), *marks)
    votes = cut(votes.groupBy("vote", *marks).count(), "langid-votes")
    said = votes.select(*marks).distinct()
    votes = votes.filter("vote IS NOT NULL")
    votes = votes.withColumn("w", F.col("count").cast("double"))
    tally = lambda *keys: votes.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys) or "true").groupBy(*keys).agg(F.array(*(F.sum(F.when(F.col("vote") == i + 1, F.col("w")).otherwise(0.0)) for i in range(n))).alias("counts"))
    total = tally().first()
    whole = np.array(total["counts"] if total and total["counts"][0] is not None else np.zeros(n)) + SMOOTHING
    prior = F.array(*(F.lit(float(x)) for x in whole / whole.sum()))
    domains = tally("_lid_domain").select("_lid_domain", _distribution(F.col("counts"), prior, DOMAIN_PRIOR).alias("_lid_dp"))
    hosts = tally("_lid_host", "_lid_domain").join(domains, "_lid_domain").select("_lid_host", "_lid_domain", _distribution(F.col("counts"), F.col("_lid_dp"), HOST_PRIOR).alias("_lid_hp"))
    suffixes = tally("_lid_suffix").select("_lid_suffix", F.zip_with(_distribution(F.col("counts"), prior, DOMAIN_PRIOR), prior, lambda p, q: F.log(p / q)).alias("_lid_sp"))
    spoken = [float(x) for x in whole + SMOOTHING]
    declared_p = tally("_lid_declared").select("_lid_declared", F.zip_with("counts", F.array(*(F.lit(x) for x in spoken)), lambda c, t: F.log((c + SMOOTHING * 0.1) / (t + SMOOTHING))).alias("_lid_lp"))
    for small, keys in ((hosts, ["_lid_host", "_lid_domain"]), (suffixes, ["_lid_suffix"]), (declared_p, ["_lid_declared"])):
        said = said.join(small, keys, "left")
    zero = F.array(*(F.lit(0.0) for _ in range(n)))
    parts = [F.transform(F.coalesce("_lid_hp", prior), lambda p: F.log(p)), F.coalesce("_lid_sp", zero), F.coalesce("_lid_lp", zero)]
    other = parts[0]
    for p in parts[1:]:
        other = F.zip_with(other, p, lambda a, b: a + b)
    # a hash names the four, so that nulls join like other values
    key = F.xxhash64(*(x for k in marks for x in (F.col(k).isNull(), F.col(k)))).alias("_lid_key")
    said = cut(said.select(key, other.alias("_lid_other")), "langid-said")
    weight = size / (1 + size / FULL)
    out = seen.withColumn("_lid_key", key).join(said, "_lid_key", "left")
    out = out.withColumn("_lid_score", F.zip_with(F.transform(means, lambda x: x * weight), "_lid_other", lambda a, b: a + b))
    best = _argmax(F.col("_lid_score"))
    top = F.array_max("_lid_score")
    probability = 1 / F.aggregate("_lid_score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    spoke = size > 0
    added = {
        "language": F.when(spoke, F.element_at(names, best)),
        "probability": F.when(spoke, probability).otherwise(0.0),
        "text_language": F.when(spoke, F.element_at(names, _argmax(means))),
        "accepted": spoke & (probability >= LEAST_PROBABILITY) & (F.element_at(means, best) >= LEAST_FIT),
    }
    return uncarried(out, columns, (), added)


def document_model(spark: SparkSession, docs: DataFrame) -> tuple[list[str], Model]:
    return fit(docs.select("doc_id", "text", F.col("lang").alias("language")))


def identify_documents(docs: DataFrame, languages: list[str], model: Model) -> DataFrame:
    """identify() for documents: lang is the declared language, source the host; they have no address suffix."""
    none = F.lit(None).cast("string")
    return identify(docs, languages, model, "text", F.col("lang"), F.col("source"), F.lit("documents"), none)


def identify_pages(pages: DataFrame, languages: list[str], model: Model) -> DataFrame:
    """identify() for pages: the html element declares, the url has host, domain (last two names of it) and
    suffix (last name, and the first path part where it has two letters)."""
    nonempty = lambda c: F.when(c != "", c)
    host = nonempty(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    suffix = F.concat(F.regexp_extract(host, "([^.]*)$", 1), F.lit("/"), F.regexp_extract("url", "^[^:]*://[^/]*/([a-zA-Z]{2})(?:/|$)", 1))
    declared = nonempty(F.regexp_extract("html", "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    return identify(pages, languages, model, "html", declared, host, F.regexp_extract(host, "([^.]*\\.?[^.]*)$", 1), suffix, markup=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: kind, doc_id or page_id, language, probability, text_language, accepted."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    languages, model = document_model(spark, docs)
    found = ["language", "probability", "text_language", "accepted"]
    d = identify_documents(docs.select("doc_id", "text", "lang", "source"), languages, model)
    p = identify_pages(pages.select("page_id", "url", "html"), languages, model)
    none = F.lit(None).cast("long")
    return d.select(F.lit("document").alias("kind"), "doc_id", none.alias("page_id"), *found).unionByName(p.select(F.lit("page").alias("kind"), none.alias("doc_id"), "page_id", *found))
