"""Building the graph store from assertion files, and reading and writing record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions.codec import lookup
from lattica.functions.text import anchor_token, english_term, json_weight, property_category
from lattica.operators.kg import first_ordinals
from lattica.schemas import MESSAGES, URI_TO_ID
from lattica.shared import cut
from lattica.sources.store import numbered_lines


def read_assertions(spark: SparkSession, path: str, parallelism: int | None = None) -> DataFrame:
    """row, relation_uri, source_uri, target_uri, metadata of a tab-separated file (gzip too); short rows are skipped.

    row is the line's number, in files by name.  A gzip file is one task to read; parallelism spreads its rows.
    """
    parts = F.split("value", "\t")
    rows = numbered_lines(spark, path).select(F.col("line").alias("row"), parts.alias("p")).filter(F.size("p") >= 5)
    rows = rows.select("row", F.get("p", F.lit(1)).alias("relation_uri"), F.get("p", F.lit(2)).alias("source_uri"), F.get("p", F.lit(3)).alias("target_uri"), F.get("p", F.lit(4)).alias("metadata"))
    return rows.repartition(parallelism) if parallelism else rows


def english_relations(assertions: DataFrame, least: float = 1.0) -> DataFrame:
    """row, source, target, relation_type_id, weight: English terms, known relations, weight at least least; scaled to 1."""
    r = assertions.select("row", english_term(F.col("source_uri")).alias("source"), english_term(F.col("target_uri")).alias("target"), lookup(URI_TO_ID, F.col("relation_uri")).alias("relation_type_id"), json_weight(F.col("metadata")).alias("w"))
    r = r.filter((F.col("w") >= least) & F.col("relation_type_id").isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull())
    return r.select("row", "source", "target", "relation_type_id", F.least(F.col("w") / 10, F.lit(1.0)).alias("weight"))


def build_graph(relations: DataFrame, max_concepts: int | None = None, definitions: DataFrame | None = None, taxonomy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """concepts and relations tables.  Concepts are numbered by first appearance, up to max_concepts; edges to
    others are dropped.  definitions(text, definition) and taxonomy(text, domain, category, subcategory,
    specificity) are optional side tables; without a category, seed words and definitions give one."""
    texts = first_ordinals(relations.select("row", "source", "target"), max_concepts).withColumnRenamed("ordinal", "id")
    c = texts.join(definitions, "text", "left") if definitions is not None else texts.withColumn("definition", F.lit(""))
    if taxonomy is not None:
        c = c.join(taxonomy, "text", "left")
    else:
        c = c.withColumns({x: F.lit(0) for x in ("domain", "category", "subcategory", "specificity")})
    kind = property_category(F.col("text"), F.coalesce("definition", F.lit("")))
    plain = F.coalesce("domain", F.lit(0)) == 0
    concepts = c.select(
        F.col("id").cast("long"), F.concat(F.lit("/c/en/"), F.replace("text", F.lit(" "), F.lit("_"))).alias("uri"), F.col("text").alias("surface_text"), anchor_token(F.col("text"), F.col("id")).alias("anchor_token"),
        F.when(plain & (kind > 0), 4).otherwise(F.coalesce("domain", F.lit(0))).alias("domain"), F.when(plain & (kind > 0), kind).otherwise(F.coalesce("category", F.lit(0))).alias("category"),
        F.coalesce("subcategory", F.lit(0)).alias("subcategory"), F.coalesce("specificity", F.lit(0)).alias("specificity"), F.coalesce("definition", F.lit("")).alias("definition"),
    )
    ids = texts.select(F.col("text"), F.col("id").cast("long"))
    e = relations.join(ids.select(F.col("text").alias("source"), F.col("id").alias("source_id")), "source").join(ids.select(F.col("text").alias("target"), F.col("id").alias("target_id")), "target")
    return concepts, e.select("row", "source_id", "target_id", "relation_type_id", "weight")


def hypernym_taxonomy(hypernyms: DataFrame, roots: DataFrame) -> DataFrame:
    """text, domain, category, subcategory, specificity from hypernyms(term, parent, pos) and roots(term, domain, category, subcategory).

    Each term follows its first parent up, to the top or to where a circle closes; the nearest mapped ancestors fill what is 0; specificity is the
    depth less one, 5 at most.
    """
    first = hypernyms.groupBy("term").agg(F.min_by("parent", "pos").alias("parent"))
    first = cut(first)
    found = walk = first.select(F.col("term").alias("text"), "parent", F.lit(1).alias("depth"))
    depth = 1
    while not walk.isEmpty():
        depth += 1
        walk = walk.select("text", F.col("parent").alias("term")).join(first, "term").select("text", "parent", F.lit(depth).alias("depth"))
        walk = cut(walk.join(found.select("text", "parent"), ["text", "parent"], "left_anti"))
        found = found.unionByName(walk)
    mapped = found.join(roots, found["parent"] == roots["term"], "left")
    g = mapped.groupBy("text").agg(F.max("depth").alias("deep"), *(F.coalesce(F.min_by(c, F.when(F.col(c) > 0, F.col("depth"))), F.lit(0)).alias(c) for c in ("domain", "category", "subcategory")))
    return g.select("text", "domain", "category", "subcategory", F.least(F.col("deep") - 1, F.lit(5)).alias("specificity"))


def insert_new(existing: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """existing with the first row of each new key: an insert that ignores duplicates."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing, key, "left_anti").select(*existing.columns))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), messages, valid: records of JSON lines, blank lines skipped but counted, bad ones kept with valid = false."""
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"messages {MESSAGES}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("line", F.col("r.messages").alias("messages"), F.col("r._corrupt_record").isNull().alias("valid"))


def write_records(records: DataFrame, path: str, order: str | None = None) -> None:
    """Write records as JSON lines, in the given order within and across files."""
    (records.repartitionByRange(order).sortWithinPartitions(order).drop(order) if order else records).write.mode("overwrite").json(path)


def latest_results(spark: SparkSession, path: str, task: str) -> DataFrame:
    """path, content of the newest JSON file below path whose results have the task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    text = files.select("path", "modificationTime", F.col("content").cast("string").alias("content"))
    fit = text.filter(F.get_json_object("content", f"$.results.{task}").isNotNull())
    return fit.orderBy(F.desc("modificationTime"), "path").limit(1).select("path", "content")
