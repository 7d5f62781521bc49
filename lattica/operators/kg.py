"""Lookups, joins, rankings and aggregates over one large graph: concepts and relations tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.schemas import RELATION_TYPES
from lattica.shared import cut, numbered, spread


def relation_types(spark: SparkSession) -> DataFrame:
    """The static dimension: id, label, inverse_label (34 rows)."""
    return spark.createDataFrame(list(RELATION_TYPES), "id int, label string, inverse_label string")


def labelled(edges: DataFrame) -> DataFrame:
    """edges with label and inverse_label; the dimension has 34 rows, so it is broadcast."""
    t = relation_types(edges.sparkSession).withColumnRenamed("id", "relation_type_id")
    return edges.join(F.broadcast(t), "relation_type_id")


def lookup_concepts(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(text) with the concept of that surface text, whatever the case; the smallest id among equals."""
    key = nodes.groupBy(F.lower("surface_text").alias("key")).agg(F.min_by(F.struct(*nodes.columns), "id").alias("n"))
    return asked.withColumn("key", F.lower("text")).join(key, "key").select("text", "n.*")


def adjacent(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch each of ids(concept_id), a self-loop once."""
    ends = edges.withColumn("concept_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))))
    return ends.join(ids, "concept_id", "left_semi")


def outgoing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with labels and the target's columns, as target_*."""
    t = nodes.select(*(F.col(c).alias(f"target_{'id' if c == 'id' else c}") for c in nodes.columns))
    return labelled(edges).join(t, "target_id")


def best_edges(edges: DataFrame, *by: str) -> DataFrame:
    """The heaviest edge of each key; the smallest target, then type among equals."""
    top = F.max_by(F.struct("target_id", "relation_type_id", "weight"), F.struct(F.col("weight"), -F.col("target_id"), -F.col("relation_type_id")))
    return edges.groupBy(*by).agg(top.alias("e")).select(*by, *(F.col(f"e.{c}").alias(c) for c in ("target_id", "relation_type_id", "weight") if c not in by))


def ranked(rows: DataFrame, by: list[str], order: list[Column], keep: int, name: str = "rank") -> DataFrame:
    """The first keep rows of each key in the order given; Spark cuts to keep before the exchange."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= keep)


def rich_concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts with 3 or more outgoing edges of 2 or more types, 1 or more of weight 0.5 or above."""
    g = spread(edges.withColumnRenamed("source_id", "id"), "id").groupBy("id").agg(F.countDistinct("relation_type_id").alias("type_count"), F.count("*").alias("total_rels"), F.sum(F.when(F.col("weight") >= 0.5, 1).otherwise(0)).alias("strong_rels"))
    return nodes.join(g.filter("total_rels >= 3 AND type_count >= 2 AND strong_rels >= 1"), "id")


def two_hop_chains(edges: DataFrame, least: float = 0.3, limit: int | None = 100000) -> DataFrame:
    """a, b, c with both weights: two edges of different types, heaviest first; a differs from b and c."""
    e = edges.filter(F.col("weight") >= least)
    one = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("relation_type_id").alias("t1"), F.col("weight").alias("w1"))
    two = e.select(F.col("source_id").alias("b"), F.col("target_id").alias("c"), F.col("relation_type_id").alias("t2"), F.col("weight").alias("w2"))
    chains = one.join(two, "b").filter("a <> c AND a <> b AND t1 <> t2").select("a", "b", "c", "t1", "t2", "w1", "w2")
    return chains.orderBy(F.desc(F.col("w1") + F.col("w2")), "a", "b", "c", "t1", "t2", "w1").limit(limit) if limit else chains


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id and the best edge of each (source, target, type) with both ends in the cluster.

    members: cluster_id, concept_id.  Two joins answer all clusters.
    """
    s = members.select("cluster_id", F.col("concept_id").alias("source_id"))
    t = members.select("cluster_id", F.col("concept_id").alias("target_id"))
    both = edges.join(s, "source_id").join(t, ["cluster_id", "target_id"])
    return both.groupBy("cluster_id", "source_id", "target_id", "relation_type_id").agg(F.max("weight").alias("weight"))


def entity_confidence(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster_id, concept_id, confidence: the heaviest edge at the concept, to two digits, 0.5 at least; 0.85 without any."""
    ends = edges.select("cluster_id", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("concept_id"), "weight")
    top = ends.groupBy("cluster_id", "concept_id").agg(F.max("weight").alias("w"))
    return members.join(top, ["cluster_id", "concept_id"], "left").select("cluster_id", "concept_id", F.coalesce(F.greatest(F.round("w", 2), F.lit(0.5)), F.lit(0.85)).alias("confidence"))


def type_combinations(edges: DataFrame, least: float = 0.3, per_type: int = 3, most: int = 3) -> DataFrame:
    """seed, targets (sorted), types: every choice of 1 to `most` types and one of the per_type best targets of each.

    A seed's best targets are one short array, and its choices grow from it level by level with rising types, without a join; a seed gives at
    most per_type ** most x C(types, most) rows; equal target sets once.
    """
    top = ranked(spread(edges.filter(F.col("weight") >= least), "source_id"), ["source_id", "relation_type_id"], [F.desc("weight"), F.asc("target_id")], per_type)
    top = top.groupBy(F.col("source_id").alias("seed")).agg(F.collect_list(F.struct(F.col("relation_type_id").alias("t"), F.col("target_id").alias("x"))).alias("top"))
    now = top.select("seed", "top", F.transform("top", lambda y: F.struct(F.array(y["t"]).alias("types"), F.array(y["x"]).alias("targets"))).alias("level")).withColumn("all", F.col("level"))
    for _ in range(most - 1):
        longer = lambda z: F.transform(F.filter("top", lambda y: y["t"] > F.element_at(z["types"], -1)), lambda y: F.struct(F.concat(z["types"], F.array(y["t"])).alias("types"), F.concat(z["targets"], F.array(y["x"])).alias("targets")))
        now = now.select("seed", "top", F.flatten(F.transform("level", longer)).alias("level"), "all")
        now = now.select("seed", "top", "level", F.concat("all", "level").alias("all"))
    out = now.select("seed", F.inline("all")).select("seed", "types", F.array_sort(F.array_distinct("targets")).alias("targets"))
    return out.groupBy("seed", "targets").agg(F.min("types").alias("types"))


def missing_pairs(subjects: DataFrame, objects: DataFrame, edges: DataFrame, per_subject: int, seed: int = 0) -> DataFrame:
    """subject, object pairs that no edge has: per_subject seeded picks for each subject, then an anti-join.

    Distinct objects are numbered and each subject picks numbers by an arithmetic hash, so no cross product is made.
    """
    places = numbered(objects.select("object").distinct(), F.col("object"))
    count = places.count()
    if not count:
        return subjects.select("subject", F.lit(None).cast("long").alias("object")).limit(0)
    picks = subjects.select("subject", F.explode(F.sequence(F.lit(0), F.lit(per_subject - 1))).alias("i"))
    picks = picks.withColumn("n", F.pmod(hashed(F.col("subject") + F.col("i") * 7919, seed), F.lit(count)))
    known = edges.select(F.col("source_id").alias("subject"), F.col("target_id").alias("object")).distinct()
    return picks.join(places, "n").select("subject", "object").distinct().join(known, ["subject", "object"], "left_anti")


def same_group(nodes: DataFrame, *by: str) -> DataFrame:
    """nodes with n_partners: how many others are in the same group.  The pairs themselves are the group's members with each other."""
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("_n"))
    return nodes.join(sizes, list(by)).withColumn("n_partners", F.col("_n") - 1).drop("_n")


def hashed(key: Column, seed: int) -> Column:
    """An arithmetic hash that other engines can repeat: (key * 2654435761 + seed * 40503) mod 2^32."""
    return F.pmod(F.pmod(key, F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(1 << 32))


def first_ordinals(pairs: DataFrame, cap: int | None = None) -> DataFrame:
    """text, ordinal (from 1): texts of pairs(row, source, target) by first appearance, source before target.

    With cap, later texts get no ordinal.  Only the distinct texts are ordered.
    """
    at = pairs.select(F.posexplode(F.array("source", "target")).alias("side", "text"), "row").groupBy("text").agg(F.min(F.col("row") * 2 + F.col("side")).alias("at"))
    out = numbered(at, F.col("at")).withColumn("ordinal", (F.col("n") + 1).cast("int"))
    return (out.filter(F.col("ordinal") <= cap) if cap else out).select("text", "ordinal")


def admitted(rows: DataFrame, quality: str, order: str, total: int) -> DataFrame:
    """Rows by quality in order: rich without limit, thin up to max(5, 20%), unknown up to max(1, 5%).  Equal places in the order are dealt as they come."""
    # the rest are few, and numbering reads them several times
    rest = numbered(cut(rows.filter(F.col(quality) != "rich")), F.col(quality), F.col(order))
    rest = rest.join(rest.groupBy(quality).agg(F.min("n").alias("_first")), quality).withColumn("nth", F.col("n") - F.col("_first") + 1)
    budget = F.when(F.col(quality) == "thin", F.lit(max(5, int(total * 0.2)))).otherwise(F.lit(max(1, int(total * 0.05))))
    return rows.filter(F.col(quality) == "rich").unionByName(rest.filter(F.col("nth") <= budget).select(*rows.columns))
