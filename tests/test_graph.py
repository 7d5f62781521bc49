"""The solver's operators on small known graphs."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import codec
from lattica.operators import graph

E = "graph_id long, seq long, rel_type string, src long, tgt long, weight double"
CHAIN = [(0, "IsA", 0, 1, 0.9), (1, "CapableOf", 1, 2, 0.8), (2, "Causes", 2, 3, 0.7)]
DIAMOND = [(0, "RelatedTo", 0, 1, 0.9), (1, "RelatedTo", 0, 2, 0.8), (2, "RelatedTo", 1, 3, 0.7), (3, "RelatedTo", 2, 3, 0.6)]


def make(spark, **graphs):
    rows = [(i, *e) for i, g in enumerate(graphs.values()) for e in g]
    return spark.createDataFrame(rows, E)


def starts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "graph_id long, start long")


def nodes_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["start"], set()).add(r["node"])
    return out


def test_reachable(spark):
    g, s = make(spark, chain=CHAIN), starts(spark, *((0, i) for i in range(4)))
    assert nodes_of(graph.reachable(g, s)) == {0: {1, 2, 3}, 1: {2, 3}, 2: {3}}
    assert nodes_of(graph.reachable(g, s, ["IsA"])) == {0: {1}}
    assert nodes_of(graph.reachable(g, s, None, 0.75)) == {0: {1, 2}, 1: {2}}
    assert nodes_of(graph.reachable(g, s, None, 0.85)) == {0: {1}}
    assert nodes_of(graph.reachable(g, s, None, 0.95)) == {}


def test_reachable_leaves_out_the_start_on_a_cycle(spark):
    g = make(spark, cycle=[(0, "IsA", 0, 1, 1.0), (1, "IsA", 1, 0, 1.0), (2, "IsA", 1, 1, 1.0)])
    assert nodes_of(graph.reachable(g, starts(spark, (0, 0)))) == {0: {1}}


@pytest.mark.parametrize(("types", "end"), [(["IsA", "CapableOf", "Causes"], 3), (["IsA", "CapableOf"], 2), (["IsA", "Causes"], None)])
def test_chain_endpoint(spark, types, end):
    assert graph.chain_endpoint(make(spark, chain=CHAIN), starts(spark, (0, 0)), types).first()["endpoint"] == end


def test_paths(spark):
    g = make(spark, diamond=DIAMOND)
    pairs = spark.createDataFrame([(0, 0, 3), (0, 2, 2)], "graph_id long, start long, end long")
    p = graph.all_paths(g, pairs)
    found = sorted((r["start"], r["path"], round(r["bottleneck"], 6), round(r["product"], 6)) for r in p.collect())
    assert found == [(0, [0, 1, 3], 0.7, 0.63), (0, [0, 2, 3], 0.6, 0.48), (2, [2], 0.0, 1.0)]
    best = {r["start"]: r["path"] for r in graph.strongest_path(p).collect()}
    assert best == {0: [0, 1, 3], 2: [2]}
    assert {r["start"]: r["path"] for r in graph.strongest_path(p, "product").collect()} == best


def test_parallel_edges_give_a_path_each_and_weigh_as_the_first(spark):
    g = make(spark, parallel=[(0, "IsA", 0, 1, 0.2), (1, "HasA", 0, 1, 0.9)])
    p = graph.all_paths(g, spark.createDataFrame([(0, 0, 1)], "graph_id long, start long, end long")).collect()
    assert [r["bottleneck"] for r in p] == [0.2, 0.2]


def test_path_weights(spark):
    p = spark.createDataFrame([(0, 7, [0, 1, 3]), (0, 8, [3, 0]), (0, 9, [1])], "graph_id long, path_id long, path array<bigint>")
    got = {r["path_id"]: (round(r["bottleneck"], 6), round(r["product"], 6)) for r in graph.path_weights(make(spark, d=DIAMOND), p).collect()}
    assert got == {7: (0.7, 0.63), 8: (0.0, 1.0), 9: (0.0, 1.0)}


def test_effective_properties(spark):
    g = make(spark, g=[(0, "IsA", 0, 1, 1.0), (1, "HasProperty", 1, 2, 1.0), (2, "NOT_HasProperty", 0, 2, 1.0)])
    lit = spark.createDataFrame([(0, 0, "fast"), (0, 1, "strong"), (0, 1, "durable")], "graph_id long, idx long, property string")
    got = {r["property"] for r in graph.effective_properties(g, starts(spark, (0, 0)), lit).collect()}
    assert got == {"fast", "strong", "durable"}


def test_prerequisites(spark):
    g = make(spark, g=[(0, "HasPrerequisite", 0, 1, 1.0), (1, "HasPrerequisite", 1, 2, 1.0), (2, "NOT_CapableOf", 0, 2, 1.0)])
    got = {r["start"]: (r["satisfiable"], r["blockers"]) for r in graph.prerequisites(g, starts(spark, (0, 0), (0, 1))).collect()}
    assert got == {0: (False, [2]), 1: (True, [])}


def test_contradictions(spark):
    g = make(spark, g=[(0, "CapableOf", 0, 1, 0.9), (1, "NOT_CapableOf", 0, 1, 0.8)], tie=[(0, "IsA", 0, 1, 0.5), (1, "NOT_IsA", 0, 1, 0.5)], neg=[(0, "IsA", 0, 1, 0.4), (1, "NOT_IsA", 0, 1, 0.5)])
    assert {r["graph_id"]: (r["n_positive"], r["n_negative"], r["resolved"]) for r in graph.contradictions(g).collect()} == {0: (1, 1, "positive"), 1: (1, 1, "positive"), 2: (1, 1, "negative")}


def test_degrees_hubs_isolated(spark):
    g = make(spark, hub=[(i, "RelatedTo", 0, i + 1, 0.8) for i in range(4)] + [(9, "RelatedTo", 2, 2, 0.8)])
    e = spark.createDataFrame([(0, i) for i in range(6)], "graph_id long, idx long")
    d = graph.degrees(g, e)
    assert {r["idx"]: r["degree"] for r in d.collect()} == {0: 4, 1: 1, 2: 3, 3: 1, 4: 1, 5: 0}
    assert [(r["idx"], r["degree"]) for r in graph.hubs(d).collect()] == [(0, 4)]
    assert [r["idx"] for r in graph.isolated(g, e).collect()] == [5]


def test_blocks_and_codec(spark):
    g = make(spark, g=[(0, "IsA", 0, 1, 0.85), (1, "NOT_HasContext", 1, 0, 0.5)])
    e = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8)], "graph_id long, idx long, conf double")
    b = graph.to_blocks(g, e)
    assert b.first()["block"] == "<sml>\nE(0|0|0|0|X0|0|0|0.9)\nE(0|0|0|0|X1|0|0|0.8)\nR(IsA|0|1|0.85|0|0)\nR(NOT_HasContext|1|0|0.50|0|0)\n</sml>"
    r = b.select(codec.parse_relations(F.col("block")).alias("r"), codec.parse_entities(F.col("block")).alias("e"), codec.in_words(F.col("block")).alias("w")).first()
    assert [(x["label"], x["rel_type_id"], x["negated"]) for x in r["r"]] == [("IsA", 1, False), ("HasContext", 30, True)]
    assert r["e"][1] == ["0", "0", "0", "0", "X1", "0", "0", "0.8"]
    assert r["w"].endswith("- X0 is a type of X1 (confidence: 0.85)\n- X1 not_hascontext X0 (confidence: 0.5)".replace("not_hascontext", "not hascontext"))


def test_empty_edges(spark):
    g = spark.createDataFrame([], E)
    assert graph.reachable(g, starts(spark, (0, 0))).count() == 0
    assert graph.chain_endpoint(g, starts(spark, (0, 0)), ["IsA"]).first()["endpoint"] is None
    assert graph.contradictions(g).count() == 0
