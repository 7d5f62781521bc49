"""Seeded question graphs and their right answers.

A graph is a struct: entities (array of idx, conf, properties) and relations (array of rel_type, src, tgt, weight), built by
column functions, one row for each graph; rows() turns a table of graphs into the entities and edges
that the graph operators take.  Numbers drawn are an arithmetic hash of graph, draw and seed, so any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import graph as G
from lattica.operators.kg import hashed
from lattica.operators.records import question_text, shuffle_choices

ENTITY = "struct<idx: bigint, conf: double, properties: array<string>>"
EDGE = "struct<rel_type: string, src: bigint, tgt: bigint, weight: double>"
GRAPH = f"struct<entities: array<{ENTITY}>, relations: array<{EDGE}>>"
# Relations of chains, the weight of a relation that is given none, and the choice where a graph says nothing.
CHAIN_RELATIONS = ("IsA", "CapableOf", "Causes", "HasPrerequisite", "PartOf", "AtLocation", "UsedFor", "RelatedTo")
WEIGHT, CONF, NOT_SAID = 0.85, 0.9, "Not specified in the SML data"


def drawn(key: Column, draw: int | Column, n: int | Column, seed: int) -> Column:
    """A number from 0 to n - 1 for the draw of a key."""
    k = draw if isinstance(draw, Column) else F.lit(draw)
    return F.pmod(hashed(key * 1009 + k, seed), n if isinstance(n, Column) else F.lit(n)).cast("int")


def drawn_weight(key: Column, draw: int | Column, low: int, high: int, seed: int) -> Column:
    """A weight of low to high hundredths."""
    return (drawn(key, draw, high - low + 1, seed) + low) / 100.0


def empty_graph() -> Column:
    return F.struct(F.array().cast(f"array<{ENTITY}>").alias("entities"), F.array().cast(f"array<{EDGE}>").alias("relations"))


def add_entities(g: Column, n: Column | int, conf: float = CONF, properties: Column | None = None) -> Column:
    """g with n more entities, numbered on from those it has; properties go to each."""
    count = n if isinstance(n, Column) else F.lit(n)
    names = (F.array() if properties is None else properties).cast("array<string>")
    more = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), 1, count), lambda i: F.struct((F.size(g["entities"]) + i).cast("long").alias("idx"), F.lit(conf).alias("conf"), names.alias("properties")))
    return F.struct(F.concat(g["entities"], more).alias("entities"), g["relations"].alias("relations"))


def add_relations(g: Column, relations: Column) -> Column:
    """g with more relations (array of rel_type, src, tgt, weight); the same pair may have many."""
    return F.struct(g["entities"].alias("entities"), F.concat(g["relations"], relations.cast(f"array<{EDGE}>")).alias("relations"))


def add_chain(g: Column, rel_types: Column, weights: Column | None = None, start: Column | None = None) -> Column:
    """struct<graph, nodes>: g with a chain of new entities, from start or else a new one; nodes are the chain's entities.

    weights must be as many as rel_types, or the row fails; without them every relation weighs WEIGHT.
    """
    n = F.size(rel_types)
    first = F.size(g["entities"]).cast("long")
    begin = first if start is None else start.cast("long")
    offset = 1 if start is None else 0
    grown = add_entities(g, n + offset)
    nodes = F.concat(F.array(begin), F.transform(rel_types, lambda _, i: first + i + offset))
    if weights is not None:
        weights = F.when(F.size(weights) == n, weights).otherwise(F.raise_error(F.lit("a chain needs a weight for each relation")).cast("array<double>"))
    relations = F.transform(rel_types, lambda t, i: F.struct(t.alias("rel_type"), F.get(nodes, i).alias("src"), F.get(nodes, i + 1).alias("tgt"), (F.lit(WEIGHT) if weights is None else F.get(weights, i)).alias("weight")))
    return F.struct(add_relations(grown, relations).alias("graph"), nodes.alias("nodes"))


def add_branch(g: Column, start: Column, depth: Column, rel_types: Column, weights: Column) -> Column:
    """struct<graph, nodes>: g with a dead end of depth new entities from start; rel_types are gone through again and again,
    and a step without a weight of its own weighs 0.7."""
    steps = F.slice(F.sequence(F.lit(0), F.greatest(depth, F.lit(0))), 1, depth)
    types = F.transform(steps, lambda i: F.get(rel_types, i % F.size(rel_types)))
    chain = add_chain(g, types, F.transform(steps, lambda i: F.coalesce(F.get(weights, i), F.lit(0.7))), start)
    return F.struct(chain["graph"].alias("graph"), F.slice(chain["nodes"], 2, F.size(steps)).alias("nodes"))


def rows(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entities(graph_id, idx, conf, properties) and edges(graph_id, seq, rel_type, src, tgt, weight) of graphs(graph_id, graph)."""
    entities = graphs.select("graph_id", F.inline("graph.entities"))
    edges = graphs.select("graph_id", F.posexplode("graph.relations").alias("seq", "r")).select("graph_id", F.col("seq").cast("long").alias("seq"), "r.*")
    return entities, edges


def distractors(n_entities: Column, exclude: Column, k: int, key: Column, seed: int) -> Column:
    """Up to k names of entities that exclude has not, in a seeded order."""
    rest = F.array_except(F.sequence(F.lit(0).cast("long"), n_entities.cast("long") - 1), exclude.cast("array<bigint>"))
    mixed = F.array_sort(F.transform(rest, lambda i: F.struct(hashed(key * 1009 + i * 31, seed).alias("h"), i.alias("i"))))
    return F.slice(F.transform(mixed, lambda x: F.concat(F.lit("X"), x["i"].cast("string"))), 1, k)


def assembled(graphs: DataFrame, blocks: DataFrame, question: Column, choices: Column, seed: int, **meta: Column) -> DataFrame:
    """graph_id, question, choices, answer and meta: the first of choices is right before they are shuffled.

    blocks: graph_id, block.  graphs has graph_id and what question, choices and meta read.
    """
    x = graphs.join(blocks, "graph_id").withColumn("_mixed", shuffle_choices(choices, F.lit(0), F.col("graph_id"), seed))
    text = question_text(F.col("block"), question, F.col("_mixed.choices"))
    return x.select("graph_id", text.alias("question"), F.col("_mixed.choices").alias("choices"), F.col("_mixed.answer").alias("answer"), *(c.alias(k) for k, c in meta.items()))


def chain_graphs(ids: DataFrame, seed: int) -> DataFrame:
    """graph_id, graph, start, end, rel_types of ids(graph_id): a chain of four or five relations and two or three dead ends from its entities."""
    k = F.col("graph_id")
    kinds = F.array(*(F.lit(t) for t in CHAIN_RELATIONS))
    hops = 4 + drawn(k, 0, 2, seed)
    steps = F.sequence(F.lit(1), hops)
    types = F.transform(steps, lambda j: F.get(kinds, drawn(k, j * 10, len(CHAIN_RELATIONS), seed)))
    weights = F.transform(steps, lambda j: drawn_weight(k, j * 10 + 1, 60, 95, seed))
    chain = ids.select("graph_id", types.alias("rel_types"), weights.alias("weights"))
    chain = chain.withColumn("c", add_chain(empty_graph(), F.col("rel_types"), F.col("weights"))).select("graph_id", "rel_types", F.col("c.graph").alias("graph"), F.col("c.nodes").alias("nodes"))

    def branch(b: int) -> tuple[Column, Column]:
        steps = F.array(F.lit(0), F.lit(1))
        return F.transform(steps, lambda j: F.get(kinds, drawn(k, j + 400 + 10 * b, len(CHAIN_RELATIONS), seed))), F.transform(steps, lambda j: drawn_weight(k, j + 500 + 10 * b, 40, 90, seed))

    for b in range(3):
        from_ = F.get("nodes", F.pmod(drawn(k, 100, 97, seed) + 2 * b, F.size("rel_types")))
        # the third one is made for every other graph
        depth = 1 + drawn(k, 200 + b, 2, seed) if b < 2 else F.when(drawn(k, 300, 2, seed) == 1, 1 + drawn(k, 200 + b, 2, seed)).otherwise(0)
        chain = chain.withColumn("graph", add_branch(F.col("graph"), from_, depth.cast("int"), *branch(b))["graph"])
    return chain.select("graph_id", "graph", F.get("nodes", F.lit(0)).alias("start"), F.element_at("nodes", -1).alias("end"), "rel_types")


def chain_questions(ids: DataFrame, seed: int) -> DataFrame:
    """Deep-chain questions: graph_id, question, choices, answer, reasoning_type, num_entities, num_relations, num_hops.

    The chain's end is the solver's answer: the first relation of each type is followed, and dead ends come later.
    """
    g = chain_graphs(ids, seed)
    entities, edges = rows(g)
    start, end = F.concat(F.lit("X"), F.col("start").cast("string")), F.concat(F.lit("X"), F.col("end").cast("string"))
    said = F.when(F.col("graph_id") % 3 == 0, F.concat(F.lit("Following the relation chain ("), F.array_join("rel_types", " → "), F.lit(") starting from "), start, F.lit(", what entity is reached at the end?")))
    said = said.when(F.col("graph_id") % 3 == 1, F.concat(F.lit("Starting at "), start, F.lit(", following the chain of relations ("), F.array_join("rel_types", ", "), F.lit("), what is the final entity?")))
    said = said.otherwise(F.concat(start, F.lit(" begins a chain of "), F.size("rel_types").cast("string"), F.lit(" relations. What entity is at the terminus of this chain?")))
    choices = F.concat(F.array(end), distractors(F.size("graph.entities"), F.array("start", "end"), 3, F.col("graph_id"), seed))
    return assembled(g, G.to_blocks(edges, entities), said, choices, seed, reasoning_type=F.lit("multi_hop_chain"), num_entities=F.size("graph.entities"), num_relations=F.size("graph.relations"), num_hops=F.size("rel_types"))


# ---------------------------------------------------------------- answers of composed questions


def exceptions(edges: DataFrame, relation: str = "CapableOf") -> DataFrame:
    """graph_id, child, parent, node: what a parent (over IsA, direct or not) has and the child itself denies."""
    return _inherited(edges, relation).filter("denied").select("graph_id", F.col("start").alias("child"), "parent", "node")


def _inherited(edges: DataFrame, relation: str) -> DataFrame:
    starts = edges.filter("rel_type = 'IsA'").select("graph_id", F.col("src").alias("start")).distinct()
    up = G.reachable(edges, starts, ["IsA"]).withColumnRenamed("node", "parent")
    has = edges.filter(F.col("rel_type") == relation).select("graph_id", F.col("src").alias("parent"), F.col("tgt").alias("node")).distinct()
    no = edges.filter(F.col("rel_type") == f"NOT_{relation}").select("graph_id", F.col("src").alias("start"), F.col("tgt").alias("node")).distinct().withColumn("denied", F.lit(True))
    return up.join(has, ["graph_id", "parent"]).join(no, ["graph_id", "start", "node"], "left").withColumn("denied", F.coalesce("denied", F.lit(False)))


def inherited(edges: DataFrame, relation: str = "CapableOf") -> DataFrame:
    """graph_id, start, node, applies: whether an inherited relation holds; a relation that the entity itself denies does not."""
    return _inherited(edges, relation).groupBy("graph_id", "start", "node").agg((~F.max("denied")).alias("applies"))


def strong_fanout(edges: DataFrame, above: float = 0.5) -> DataFrame:
    """graph_id, src, n, best: how many relations of an entity weigh more than `above`, and the target of its heaviest, the first among equals."""
    best = F.max_by("tgt", F.struct(F.col("weight"), -F.col("seq")))
    return edges.groupBy("graph_id", "src").agg(F.sum((F.col("weight") > above).cast("long")).alias("n"), best.alias("best"))


def threshold_members(edges: DataFrame, starts: DataFrame, entities: DataFrame, least: float) -> DataFrame:
    """graph_id, start, node, member: every other entity, and whether relations of that weight lead to it; so wrong choices are checked.

    A start's row meets the nodes of its graph and those it reaches as arrays, and is spread out last.
    """
    got = G.reachable(edges, starts, None, least).groupBy("graph_id", "start").agg(F.collect_list("node").alias("_got"))
    nodes = entities.groupBy("graph_id").agg(F.collect_list("idx").alias("_all"))
    x = starts.select("graph_id", "start").distinct().join(nodes, "graph_id").join(got, ["graph_id", "start"], "left")
    x = x.select("graph_id", "start", F.filter("_all", lambda n: n != F.col("start")).alias("_all"), F.coalesce("_got", F.array().cast("array<bigint>")).alias("_got"))
    row = lambda n, member: F.struct(n.alias("node"), member.alias("member"))
    # set functions take one pass where no node is listed twice
    sets = F.concat(F.transform(F.array_intersect("_all", "_got"), lambda n: row(n, F.lit(True))), F.transform(F.array_except("_all", "_got"), lambda n: row(n, F.lit(False))))
    each = F.transform("_all", lambda n: row(n, F.array_contains("_got", n)))
    return x.select("graph_id", "start", F.inline(F.when(F.size("_all") == F.size(F.array_distinct("_all")), sets).otherwise(each)))