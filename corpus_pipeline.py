"""Corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing over documents.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that
is written and read again as the next one's docs.  All but the last return the columns of docs, extra ones too, whatever
their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, table
from lattica.llm.jaccard import jaccard_rows, text_hash
from lattica.llm.langid import document_model, identify_documents
from lattica.llm.line_dedup import dedup_lines
from lattica.llm.mixing import mixed
from lattica.llm.packing import pack_best_fit


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; lang becomes the language found.

    Null texts, texts of white space alone and texts of no sure language go; repeated rows are judged alike.
    """
    found = identify_documents(docs, *document_model(spark, docs)).filter("accepted")
    return found.select(*(F.col("language").alias("lang") if c == "lang" else c for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their new lines only; those that had lines and have none left go.

    Null and empty texts stay as they are.  Rows of one doc_id and text keep the same lines; rows without an id come last.
    """
    d = dedup_lines(docs).filter("n_lines = 0 OR n_kept > 0")
    new = {"text": F.col("line_text"), "n_chars": F.char_length("line_text").cast(dict(docs.dtypes).get("n_chars", "int"))}
    return d.select(*(new[c].alias(c) if c in new else c for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: of the smallest doc_id in it, null last, and there of the smallest text hash.

    Decided by row, as rows of one doc_id may have unlike texts.  Rows without words link with nothing and stay.
    """
    keys = ["_id", "_null", "_hash"]
    named = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null")]
    rows = cut(jaccard_rows(docs).select(*named, F.col("text_hash").alias("_hash"), "label"), "pipeline-components")
    first = rows.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("_null", "_id", "_hash")).alias("k"))
    first = first.select(*(F.col("k")[k].alias(k) for k in keys), F.lit(True).alias("_once"))
    kept = cut(first.unionByName(rows.filter("label IS NULL").select(*keys, F.lit(False).alias("_once")).distinct()), "pipeline-kept")
    # joined and ranked by the same keys, so texts are exchanged once
    found = docs.select("*", *named, text_hash(F.col("text")).alias("_hash")).join(kept, keys)
    ranked = found.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*docs.columns)))
    return ranked.filter("_row = 1 OR NOT _once").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them; not at all where the budget of their leaf is used up.

    Null and empty names are one leaf; documents without tokens follow their order key, and repeated rows go or stay together.
    """
    m = mixed(docs).withColumn("mix_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return m.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of all documents: doc_id, piece, bin_id, slot, start, n_tokens; null and empty texts take a slot without tokens."""
    return pack_best_fit(docs)


STAGES = [
    ("language id", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
