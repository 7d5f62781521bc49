"""The stored graph: a pair of Parquet tables, concepts and relations, and what is looked up in it."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import anchor_token
from lattica.shared import numbered


@dataclasses.dataclass(frozen=True)
class Store:
    """concepts: id, surface_text, anchor_token, domain, category, subcategory, specificity, any others.
    relations: id, source_id, target_id, relation_type_id, weight, any others."""

    concepts: DataFrame
    relations: DataFrame


def with_edge_ids(relations: DataFrame, *order: Column) -> DataFrame:
    """relations with id, numbered from 1 in the order given."""
    return numbered(relations, *order, name="id").withColumn("id", F.col("id") + 1)


def append_relations(store: Store, relations: DataFrame, *order: Column) -> Store:
    """The store with more relations, numbered on from its largest id."""
    last = store.relations.agg(F.max("id")).first()[0] or 0
    more = with_edge_ids(relations, *order).withColumn("id", F.col("id") + last)
    return Store(store.concepts, store.relations.unionByName(more.select(*store.relations.columns)))


def replace_store(store: Store, path: str) -> None:
    """Write the store to path; what was there goes.  Relations are dealt by source, so that adjacency reads few files."""
    store.concepts.write.mode("overwrite").parquet(f"{path}/concepts")
    store.relations.repartition("source_id").sortWithinPartitions("source_id").write.mode("overwrite").parquet(f"{path}/relations")


def from_fixture(concepts: DataFrame, edges: DataFrame, types: DataFrame) -> Store:
    """A store of hand-written rows: concepts(line, surface_text, domain, category, subcategory, specificity) and edges(line, source, label, target, weight).

    Ids follow the lines; ends and labels that are not known are left out.  types: id, label; of equal labels the largest id counts.
    """
    c = numbered(concepts, F.col("line"), name="_n")
    c = c.select((F.col("_n") + 1).alias("id"), "surface_text", anchor_token(F.col("surface_text"), F.col("_n") + 1).alias("anchor_token"), "domain", "category", "subcategory", "specificity")
    ids = c.groupBy("surface_text").agg(F.min("id").alias("id"))
    kinds = types.groupBy("label").agg(F.max("id").alias("relation_type_id"))
    e = edges.join(ids.select(F.col("surface_text").alias("source"), F.col("id").alias("source_id")), "source").join(ids.select(F.col("surface_text").alias("target"), F.col("id").alias("target_id")), "target").join(kinds, "label")
    return Store(c, with_edge_ids(e, F.col("line")).select("id", "source_id", "target_id", "relation_type_id", "weight"))


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark.read.parquet(f"{path}/concepts"), spark.read.parquet(f"{path}/relations"))


def by_anchor(concepts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(anchor_token) with the concept of that anchor, the smallest id among equals; those without one are left out."""
    first = concepts.join(asked.select("anchor_token").distinct(), "anchor_token", "left_semi").groupBy("anchor_token").agg(F.min_by(F.struct(*[c for c in concepts.columns if c != "anchor_token"]), "id").alias("c"))
    return asked.join(first, "anchor_token").select(*asked.columns, "c.*")


def taxonomy(concepts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(id) with domain, category, subcategory, specificity; nulls where there is no such concept."""
    return asked.join(concepts.select("id", "domain", "category", "subcategory", "specificity"), "id", "left")


def slices(concepts: DataFrame) -> DataFrame:
    """concepts with kinds, an array: what a concept serves as in prompts."""
    d, k = F.col("domain"), F.col("category")
    kinds = ((d.isin(1, 2), "entity"), (d == 3, "action"), (d == 4, "property"), ((d == 1) & (k == 4), "place"))
    return concepts.withColumn("kinds", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in kinds))))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value of the text files at path, in the order of their names."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return numbered(rows, F.col("_f"), F.col("_b"), F.col("_m"), name="line").select("line", "value")
