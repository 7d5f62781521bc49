"""Graph operators over many graphs at once.

edges: graph_id, seq (insertion order), rel_type, src, tgt, weight.  starts: graph_id, start (any others).
entities: graph_id, idx, properties (array<string>).  Every operator answers all graphs and starts in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.shared import cut


#: Edges of a graph that is worked on as one row.
FOLDED = 64


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.filter(F.col("rel_type").isin(types)) if types else edges


def first_edges(edges: DataFrame, *by: str) -> DataFrame:
    """The first inserted edge of each graph and key."""
    return edges.groupBy("graph_id", *by).agg(F.min_by(F.struct("tgt", "weight"), "seq").alias("e")).select("graph_id", *by, *(F.col(f"e.{c}").alias(c) for c in ("tgt", "weight") if c not in by))


def reachable(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, least: float | None = None) -> DataFrame:
    """graph_id, start, node: all that paths of edges of the types, of weight least or more, lead to from start.

    The start itself is left out, also where a cycle leads back.  Graphs of up to FOLDED distinct edges are one row each,
    whose closure is taken without a join.  For larger ones, each round joins only the last round's new
    nodes; the rounds end when there are none, so their number is the longest shortest path.
    """
    e = of_types(edges, types)
    e = (e.filter(F.col("weight") >= least) if least is not None else e).select("graph_id", "src", "tgt").distinct()
    e = cut(e.join(e.groupBy("graph_id").agg(F.count("*").alias("_size")), "graph_id"))
    starts = starts.select("graph_id", "start").distinct()
    folded = e.filter(F.col("_size") <= FOLDED).groupBy("graph_id").agg(F.collect_list(F.struct("src", "tgt")).alias("pairs"))
    step = lambda seen, _: F.array_union(seen, F.transform(F.filter("pairs", lambda p: F.array_contains(seen, p["src"])), lambda p: p["tgt"]))
    rounds = F.sequence(F.lit(1), F.size(F.array_distinct(F.transform("pairs", lambda p: p["src"]))))
    small = starts.join(folded, "graph_id").select("graph_id", "start", F.explode(F.aggregate(rounds, F.array("start"), step)).alias("node")).filter("node <> start")
    large = e.filter(F.col("_size") > FOLDED).drop("_size")
    return small if large.isEmpty() else small.unionByName(_spread(large, starts))


def _spread(e: DataFrame, starts: DataFrame) -> DataFrame:
    """reachable() round by round, for distinct edges e and distinct starts."""
    e = cut(e)
    found = cut(starts.join(e.select("graph_id").distinct(), "graph_id", "left_semi").select("graph_id", "start", F.col("start").alias("node")))
    frontier = found
    while not frontier.isEmpty():
        step = frontier.join(e, (frontier["graph_id"] == e["graph_id"]) & (frontier["node"] == e["src"])).select(frontier["graph_id"], "start", F.col("tgt").alias("node")).distinct()
        frontier = cut(step.join(found, ["graph_id", "start", "node"], "left_anti"))
        found = found.unionByName(frontier)
    return found.filter("node <> start")


def chain_endpoint(edges: DataFrame, starts: DataFrame, types: list[str]) -> DataFrame:
    """graph_id, start, endpoint: follow the first edge of each type in turn; null where the chain breaks."""
    first = first_edges(edges, "rel_type", "src")
    at = starts.select("graph_id", "start", F.col("start").alias("at"))
    for i, t in enumerate(types):
        e = first.filter(F.col("rel_type") == t).select("graph_id", F.col("src").alias("at"), F.col("tgt").alias(f"to{i}"))
        at = at.join(e, ["graph_id", "at"], "left").select("graph_id", "start", F.col(f"to{i}").alias("at"))
    return at.withColumnRenamed("at", "endpoint")


def all_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """graph_id, start, end, path, bottleneck, product: simple paths of max_depth edges at most.

    Paths stop at end; parallel edges give a path each; start = end gives [start].  A hop weighs what the first
    edge between its nodes weighs; the empty path has bottleneck 0 and product 1.  order_key is the edges' order along the path.
    """
    w = Window.partitionBy("graph_id", "src", "tgt").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hops = cut(edges.select("graph_id", "src", "tgt", "seq", F.first("weight").over(w).alias("hop")))
    now = pairs.select("graph_id", "start", "end", F.array("start").alias("path"), F.lit(None).cast("double").alias("low"), F.lit(1.0).alias("product"), F.array().cast("array<bigint>").alias("order_key"))
    done = now.filter("start = end")
    now = now.filter("start <> end")
    for _ in range(max_depth):
        now = now.withColumn("at", F.element_at("path", -1)).join(hops.withColumnRenamed("src", "at"), ["graph_id", "at"]).filter(~F.array_contains("path", F.col("tgt")))
        now = now.select("graph_id", "start", "end", F.concat("path", F.array("tgt")).alias("path"), F.coalesce(F.least("low", "hop"), "hop").alias("low"), (F.col("product") * F.col("hop")).alias("product"), F.concat("order_key", F.array(F.col("seq").cast("bigint"))).alias("order_key"))
        now = cut(now)
        if now.isEmpty():
            break
        done = done.unionByName(now.filter(F.element_at("path", -1) == F.col("end")))
        now = now.filter(F.element_at("path", -1) != F.col("end"))
    return done.withColumn("bottleneck", F.coalesce("low", F.lit(0.0))).drop("low")


def strongest_path(paths: DataFrame, by: str = "bottleneck") -> DataFrame:
    """The path of the largest bottleneck or product for each pair; the earliest in search order among equals."""
    w = Window.partitionBy("graph_id", "start", "end").orderBy(F.desc(by), F.asc("order_key"))
    return paths.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def path_weights(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """path_id, bottleneck, product of given paths(graph_id, path_id, path): missing hops are passed over."""
    hop = paths.select("graph_id", "path_id", F.posexplode("path").alias("i", "src"), "path").withColumn("tgt", F.get("path", F.col("i") + 1)).filter("tgt IS NOT NULL")
    first = edges.groupBy("graph_id", "src", "tgt").agg(F.min_by("weight", "seq").alias("weight"))
    got = hop.join(first, ["graph_id", "src", "tgt"]).groupBy("path_id").agg(F.min("weight").alias("bottleneck"), F.product("weight").alias("product"))
    return paths.select("path_id").join(got, "path_id", "left").select("path_id", F.coalesce("bottleneck", F.lit(0.0)).alias("bottleneck"), F.coalesce("product", F.lit(1.0)).alias("product"))


def effective_properties(edges: DataFrame, starts: DataFrame, literals: DataFrame | None = None) -> DataFrame:
    """graph_id, start, property: own and inherited (over IsA) properties, but for those that the entity's own
    NOT_HasProperty edges deny.  literals: graph_id, idx, property (names); targets are named X{node}."""
    own = starts.select("graph_id", "start", F.col("start").alias("node")).distinct()
    bearers = own.unionByName(reachable(edges, starts, ["IsA"]))
    has = edges.filter("rel_type = 'HasProperty'").select("graph_id", F.col("src").alias("node"), F.concat(F.lit("X"), F.col("tgt").cast("string")).alias("property"))
    if literals is not None:
        has = has.unionByName(literals.select("graph_id", F.col("idx").alias("node"), "property"))
    denied = edges.filter("rel_type = 'NOT_HasProperty'").select("graph_id", F.col("src").alias("start"), F.concat(F.lit("X"), F.col("tgt").cast("string")).alias("property"))
    return bearers.join(has, ["graph_id", "node"]).select("graph_id", "start", "property").distinct().join(denied, ["graph_id", "start", "property"], "left_anti")


def prerequisites(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """graph_id, start, satisfiable, blockers (sorted): prerequisites, direct or not, that the entity is not capable of."""
    needs = reachable(edges, starts, ["HasPrerequisite"])
    cannot = edges.filter("rel_type = 'NOT_CapableOf'").select("graph_id", F.col("src").alias("start"), F.col("tgt").alias("node")).distinct()
    blocked = needs.join(cannot, ["graph_id", "start", "node"], "left_semi").groupBy("graph_id", "start").agg(F.array_sort(F.collect_list("node")).alias("b"))
    out = starts.select("graph_id", "start").distinct().join(blocked, ["graph_id", "start"], "left")
    return out.select("graph_id", "start", F.col("b").isNull().alias("satisfiable"), F.coalesce("b", F.array().cast("array<bigint>")).alias("blockers"))


def contradictions(edges: DataFrame) -> DataFrame:
    """graph_id, src, tgt, n_positive, n_negative, resolved: pairs with edges both ways; the heavier sign wins, positive on ties."""
    negative = F.col("rel_type").startswith("NOT_")
    base = F.when(negative, F.substring("rel_type", 5, 100)).otherwise(F.col("rel_type"))
    g = edges.groupBy("graph_id", "src", "tgt", base.alias("base")).agg(F.sum(F.when(~negative, 1).otherwise(0)).alias("n_positive"), F.sum(F.when(negative, 1).otherwise(0)).alias("n_negative"), F.max(F.when(~negative, F.col("weight"))).alias("p"), F.max(F.when(negative, F.col("weight"))).alias("n"))
    return g.filter("n_positive > 0 AND n_negative > 0").select("graph_id", "src", "tgt", "base", "n_positive", "n_negative", F.when(F.col("p") >= F.col("n"), "positive").otherwise("negative").alias("resolved"))


def degrees(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """graph_id, idx, in_degree, out_degree, degree for every entity; a self-loop counts in both."""
    ends = edges.select("graph_id", F.col("src").alias("idx"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("graph_id", "tgt", F.lit(0), F.lit(1)))
    d = ends.groupBy("graph_id", "idx").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    out = entities.select("graph_id", "idx").join(d, ["graph_id", "idx"], "left")
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return out.select("graph_id", "idx", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"))


def hubs(degree: DataFrame, k: int = 1) -> DataFrame:
    """The k entities of the highest degree of each graph, then the smallest idx."""
    w = Window.partitionBy("graph_id").orderBy(F.desc("degree"), "idx")
    return degree.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def isolated(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that no edge touches."""
    touched = edges.select("graph_id", F.col("src").alias("idx")).union(edges.select("graph_id", "tgt")).distinct()
    return entities.select("graph_id", "idx").join(touched, ["graph_id", "idx"], "left_anti")


def to_blocks(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """graph_id, block: entities as X{idx} with their confidence, then relations with two-digit weights."""
    e = entities.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "conf"))), lambda x: F.concat(F.lit("E(0|0|0|0|X"), x["idx"].cast("string"), F.lit("|0|0|"), x["conf"].cast("string"), F.lit(")"))).alias("e"))
    r = edges.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "rel_type", "src", "tgt", "weight"))), lambda x: F.concat(F.lit("R("), F.concat_ws("|", x["rel_type"], x["src"].cast("string"), x["tgt"].cast("string"), F.format_string("%.2f", x["weight"])), F.lit("|0|0)"))).alias("r"))
    lines = F.concat("e", F.coalesce("r", F.array().cast("array<string>")))
    return e.join(r, "graph_id", "left").select("graph_id", F.concat(F.lit("<sml>\n"), F.array_join(lines, "\n"), F.lit("\n</sml>")).alias("block"))
