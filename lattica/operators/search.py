"""Full-text search over concepts: postings, all-terms match with a prefix for the last, BM25 ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(nodes: DataFrame, *columns: str) -> DataFrame:
    """token, id, tf, length: one row for each word of each concept."""
    text = F.lower(F.concat_ws(" ", *(F.col(c) for c in columns)))
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")
    rows = nodes.select("id", words.alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("token"))
    return rows.groupBy("token", "id", "length").agg(F.count("*").alias("tf"))


def query_terms(text: str) -> list[str]:
    """Letters, digits and _ of each word; other characters vanish."""
    return "".join(x for x in text.lower() if x.isalnum() or x == "_" or x.isspace()).split()


def search(posts: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """id, score, rank: concepts with all terms, the last as a prefix, best BM25 first, then the smallest id."""
    terms = query_terms(text)
    if not terms:
        return posts.select("id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    match = [(F.col("token") == t) if i < len(terms) - 1 else F.col("token").startswith(t) for i, t in enumerate(terms)]
    docs = posts.select("id", "length").distinct()
    size = docs.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
    hit = posts.select("id", "length", "tf", F.explode(F.array_compact(F.array(*(F.when(m, F.lit(i)) for i, m in enumerate(match))))).alias("term"))
    hit = hit.groupBy("id", "length", "term").agg(F.sum("tf").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    got = hit.join(F.broadcast(df), "term").join(F.broadcast(size)).groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("terms")).filter(F.col("terms") == len(terms))
    top = got.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
    return top.select("id", "score", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"))
