"""The driver's tables, and the graphs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import anchor_token
from lattica.shared import parts, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, surface_text, domain, category: one concept for each entity and each distinct attribute value."""
    t = lambda name: table(spark, sf_dir, name)

    def some(df: DataFrame, ident, text: str, domain: int, category: int) -> DataFrame:
        return df.select(ident.cast("long").alias("id"), F.lower(text).alias("surface_text"), F.lit(domain).alias("domain"), F.lit(category).alias("category"))

    # distinct types and segments are small dimensions, numbered in one task
    types = t("part").select("p_type").distinct().withColumn("n", F.expr("dense_rank() OVER (ORDER BY p_type)"))
    segments = t("customer").select("c_mktsegment").distinct().withColumn("n", F.expr("dense_rank() OVER (ORDER BY c_mktsegment)"))
    brands = t("part").select("p_brand").distinct().withColumn("n", F.expr("cast(replace(p_brand, 'Brand#', '') AS int)"))
    parts = [
        some(t("region"), 1000000 + F.col("r_regionkey"), "r_name", 1, 4),
        some(t("nation"), 2000000 + F.col("n_nationkey"), "n_name", 1, 4),
        some(t("supplier"), 3000000 + F.col("s_suppkey"), "s_name", 1, 2),
        some(t("part"), 4000000 + F.col("p_partkey"), "p_name", 1, 2),
        some(t("customer"), 5000000 + F.col("c_custkey"), "c_name", 1, 1),
        some(types, 6000000 + F.col("n"), "p_type", 2, 0),
        some(brands, 7000000 + F.col("n"), "p_brand", 4, 0),
        some(segments, 8000000 + F.col("n"), "c_mktsegment", 4, 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes() in the stored form: with subcategory and specificity (0) and anchor_token."""
    n = nodes(spark, sf_dir)
    return n.select("id", "surface_text", anchor_token(F.col("surface_text"), F.col("id")).alias("anchor_token"), "domain", "category", F.lit(0).alias("subcategory"), F.lit(0).alias("specificity"))


def edges(spark: SparkSession, sf_dir: str, types: tuple[int, ...] = (1, 2, 4, 5, 6, 18)) -> DataFrame:
    """source_id, target_id, relation_type_id, weight, negated of the derived graph, of the types asked for.

    Order lines are dealt into parts by the size of their table before they are grouped: groups of a supplier's or customer's part are mostly of one
    line, so grouping before the exchange saves nothing, and a task's groups stay as many however large the table is.
    """
    t = lambda name: table(spark, sf_dir, name)

    def some(df: DataFrame, s, o, kind: int, w, negated: bool = False) -> DataFrame:
        return df.select(s.cast("long").alias("source_id"), o.cast("long").alias("target_id"), F.lit(kind).alias("relation_type_id"), w.cast("double").alias("weight"), F.lit(negated).alias("negated"))

    c = F.col
    found = []
    if 2 in types:
        found.append(some(t("nation"), 2000000 + c("n_nationkey"), 1000000 + c("n_regionkey"), 2, F.lit(1.0)))
    if 6 in types:
        found.append(some(t("supplier"), 3000000 + c("s_suppkey"), 2000000 + c("s_nationkey"), 6, F.lit(0.5) + (c("s_suppkey") % 50) / 100.0))
        found.append(some(t("customer"), 5000000 + c("c_custkey"), 2000000 + c("c_nationkey"), 6, F.lit(0.5) + (c("c_custkey") % 50) / 100.0))
    if 5 in types:
        pairs = spread(t("lineitem").select("l_suppkey", "l_partkey", "l_returnflag"), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.sum(F.when(c("l_returnflag") == "R", 1).otherwise(0)).alias("r"))
        # one grouping gives both signs
        signs = F.array(F.struct(F.least(F.lit(1.0), c("n") / 4.0).alias("w"), F.lit(False).alias("negated")), F.when(c("r") > 0, F.struct((c("r") / 4.0).alias("w"), F.lit(True).alias("negated"))))
        signed = pairs.select("l_suppkey", "l_partkey", F.inline(F.array_compact(signs)))
        found.append(signed.select((3000000 + c("l_suppkey")).cast("long").alias("source_id"), (4000000 + c("l_partkey")).cast("long").alias("target_id"), F.lit(5).alias("relation_type_id"), c("w").alias("weight"), "negated"))
    if 1 in types:
        kinds = t("part").select("p_type").distinct().withColumn("n", F.expr("dense_rank() OVER (ORDER BY p_type)"))
        found.append(some(t("part").join(kinds, "p_type"), 4000000 + c("p_partkey"), 6000000 + c("n"), 1, F.lit(0.9)))
    if 4 in types:
        found.append(some(t("part"), 4000000 + c("p_partkey"), 7000000 + F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int"), 4, F.lit(0.3) + (c("p_size") % 50) / 100.0))
        seg = t("customer").select("c_mktsegment").distinct().withColumn("n", F.expr("dense_rank() OVER (ORDER BY c_mktsegment)"))
        found.append(some(t("customer").join(seg, "c_mktsegment"), 5000000 + c("c_custkey"), 8000000 + c("n"), 4, F.lit(0.8)))
    if 18 in types:
        lines = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        n = parts(lines)
        want = spread(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", n=n).join(spread(lines, "l_orderkey", n=n), c("o_orderkey") == c("l_orderkey"))
        want = spread(want.select("o_custkey", "l_partkey", "l_quantity"), "o_custkey", "l_partkey", n=n).groupBy("o_custkey", "l_partkey").agg(F.sum(c("l_quantity").cast("double")).alias("q"))
        found.append(some(want, 5000000 + c("o_custkey"), 4000000 + c("l_partkey"), 18, F.least(F.lit(1.0), c("q") / 100.0)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


#: Relation types of the small graphs, by l_partkey mod 6.
SMALL_TYPES = ("IsA", "HasProperty", "HasPrerequisite", "CapableOf", "NOT_CapableOf", "NOT_HasProperty")


def small_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, seq, rel_type, src, tgt, weight: one small graph for each order, of nodes 0 to 4, with cycles,
    self-loops and parallel edges."""
    n = F.array(*(F.lit(t) for t in SMALL_TYPES))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("graph_id"), (F.col("l_linenumber") * F.lit(10**13) + F.col("l_partkey") * F.lit(10**7) + F.col("l_suppkey") * F.lit(100) + F.col("l_quantity").cast("int")).cast("long").alias("seq"), F.get(n, (F.col("l_partkey") % 6).cast("int")).alias("rel_type"),
        (F.col("l_partkey") % 5).cast("long").alias("src"), (F.col("l_suppkey") % 5).cast("long").alias("tgt"), ((F.col("l_quantity").cast("int") % 50 + 50) / 100.0).cast("double").alias("weight"),
    )


def small_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, idx, conf: nodes 0 to 4 of each small graph."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("graph_id"), F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("idx"), F.lit(0.9).alias("conf"))


#: The same views for DuckDB, to be put after WITH RECURSIVE.
VIEWS_SQL = """
kinds AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) AS n FROM (SELECT DISTINCT p_type FROM part)),
segs AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)),
nodes AS (
  SELECT CAST(1000000 + r_regionkey AS BIGINT) AS id, lower(r_name) AS surface_text, 1 AS domain, 4 AS category FROM region
  UNION ALL SELECT 2000000 + n_nationkey, lower(n_name), 1, 4 FROM nation
  UNION ALL SELECT 3000000 + s_suppkey, lower(s_name), 1, 2 FROM supplier
  UNION ALL SELECT 4000000 + p_partkey, lower(p_name), 1, 2 FROM part
  UNION ALL SELECT 5000000 + c_custkey, lower(c_name), 1, 1 FROM customer
  UNION ALL SELECT 6000000 + n, lower(p_type), 2, 0 FROM kinds
  UNION ALL SELECT 7000000 + CAST(replace(p_brand, 'Brand#', '') AS INT), lower(p_brand), 4, 0 FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT 8000000 + n, lower(c_mktsegment), 4, 0 FROM segs
),
pairs AS (SELECT l_suppkey, l_partkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY ALL),
edges AS (
  SELECT CAST(2000000 + n_nationkey AS BIGINT) AS source_id, CAST(1000000 + n_regionkey AS BIGINT) AS target_id, 2 AS relation_type_id, CAST(1.0 AS DOUBLE) AS weight, false AS negated FROM nation
  UNION ALL SELECT 3000000 + s_suppkey, 2000000 + s_nationkey, 6, CAST(0.5 AS DOUBLE) + CAST(s_suppkey % 50 AS DOUBLE) / 100, false FROM supplier
  UNION ALL SELECT 5000000 + c_custkey, 2000000 + c_nationkey, 6, CAST(0.5 AS DOUBLE) + CAST(c_custkey % 50 AS DOUBLE) / 100, false FROM customer
  UNION ALL SELECT 3000000 + l_suppkey, 4000000 + l_partkey, 5, least(CAST(1 AS DOUBLE), CAST(n AS DOUBLE) / 4), false FROM pairs
  UNION ALL SELECT 3000000 + l_suppkey, 4000000 + l_partkey, 5, CAST(r AS DOUBLE) / 4, true FROM pairs WHERE r > 0
  UNION ALL SELECT 4000000 + p_partkey, 6000000 + n, 1, CAST(0.9 AS DOUBLE), false FROM part JOIN kinds USING (p_type)
  UNION ALL SELECT 4000000 + p_partkey, 7000000 + CAST(replace(p_brand, 'Brand#', '') AS INT), 4, CAST(0.3 AS DOUBLE) + CAST(p_size % 50 AS DOUBLE) / 100, false FROM part
  UNION ALL SELECT 5000000 + c_custkey, 8000000 + n, 4, CAST(0.8 AS DOUBLE), false FROM customer JOIN segs USING (c_mktsegment)
  UNION ALL SELECT 5000000 + o_custkey, 4000000 + l_partkey, 18, least(CAST(1 AS DOUBLE), sum(CAST(l_quantity AS DOUBLE)) / 100), false FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey
),
small AS (
  SELECT CAST(l_orderkey AS BIGINT) AS graph_id, CAST(l_linenumber AS BIGINT) * 10000000000000 + CAST(l_partkey AS BIGINT) * 10000000 + l_suppkey * 100 + CAST(l_quantity AS INT) AS seq,
    ['IsA', 'HasProperty', 'HasPrerequisite', 'CapableOf', 'NOT_CapableOf', 'NOT_HasProperty'][l_partkey % 6 + 1] AS rel_type,
    CAST(l_partkey % 5 AS BIGINT) AS src, CAST(l_suppkey % 5 AS BIGINT) AS tgt, CAST(CAST(l_quantity AS INT) % 50 + 50 AS DOUBLE) / 100 AS weight FROM lineitem
),
ents AS (SELECT CAST(o_orderkey AS BIGINT) AS graph_id, CAST(i AS BIGINT) AS idx FROM orders, range(0, 5) AS g(i))
"""
