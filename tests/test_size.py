"""What a task holds must not grow with the tables: plans and parts, by the size of the input."""

import re

import pytest
from pyspark.sql import functions as F

from lattica import shared
from lattica.functions import codec
from lattica.operators import clusters, encoder, evaluation, kg, questions, records
from lattica.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
EDGE = "source_id long, target_id long, relation_type_id int, weight double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_files(spark, tmp_path, monkeypatch):
    spark.range(20000).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    size = shared.input_bytes(t)
    assert size > 0 and shared.input_bytes(spark.createDataFrame([(1,)], "id long").join(t, "id")) == size
    assert shared.parts(t) == 4
    monkeypatch.setattr(shared, "PART", size // 50)
    assert 50 <= shared.parts(t) <= 52 and shared.spread(t, "id").rdd.getNumPartitions() == shared.parts(t)


def dealt(name, spark, monkeypatch, keys):
    """How many parts the keys are dealt into when a part stands for 2 KB of input, and by default."""
    monkeypatch.setattr(shared, "PART", 1 << 40)
    few = re.findall(rf"hashpartitioning\({keys}, (\d+)\), REPARTITION_BY_NUM", plan(QUERIES[name](spark, SF)))
    monkeypatch.setattr(shared, "PART", 2048)
    many = re.findall(rf"hashpartitioning\({keys}, (\d+)\), REPARTITION_BY_NUM", plan(QUERIES[name](spark, SF)))
    assert few and set(few) == {"4"} and min(map(int, many)) > 20


SUPPLIED, WANTED = r"l_suppkey#\d+L, l_partkey#\d+L", r"o_custkey#\d+L, l_partkey#\d+L"


@pytest.mark.parametrize("name", ["a3_best_edge_of_source", "w1_top_targets_by_type", "w8_one_edge_of_each_type"])
def test_edges_are_grouped_in_parts_by_size(spark, monkeypatch, name):
    for keys in (SUPPLIED, WANTED):
        dealt(name, spark, monkeypatch, keys)


def test_pairs_are_appended_in_parts_by_size(spark, monkeypatch):
    dealt("t6_append_new_pairs", spark, monkeypatch, r"source_id#\d+L, target_id#\d+L")


@pytest.mark.parametrize(("name", "keys"), [("m1_relation_prompts", r"kind#\d+, source#\d+, target#\d+"), ("w5_first_of_duplicates", r"_key#\d+"), ("a17_unique_prompts", r"kind#\d+, prompt#\d+")])
def test_prompts_are_told_apart_in_parts_by_size(spark, monkeypatch, name, keys):
    dealt(name, spark, monkeypatch, keys)


def test_prompts_are_never_dealt_by_kind_alone(spark):
    pairs = spark.createDataFrame([("a", "x", "y"), ("a", "x", "y"), ("b", "x", "{target}"), ("c", "x", "y")], "kind string, source string, target string")
    t = spark.createDataFrame([("a", "{source} {target}"), ("a", "{source} y"), ("b", "is {source} {target}?")], "kind string, template string")
    out = records.fill_templates(pairs, t)
    assert sorted(out.collect()) == [("a", "x", "y", "x y"), ("b", "x", "{target}", "is x {target}?")]
    assert not re.search(r"SortMergeJoin \[kind", plan(out))


def test_type_combinations_need_no_join(spark):
    e = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.8), (1, 2, 4, 0.7), (1, 9, 4, 0.1)], EDGE)
    out = kg.type_combinations(e)
    assert "Join" not in plan(out)
    assert {(tuple(r["targets"]), tuple(r["types"])) for r in out.collect()} == {((2,), (1,)), ((3,), (2,)), ((2, 3), (1, 2))}


def test_training_blocks_are_dealt_by_text_once(spark):
    assert set(re.findall(r"Exchange hashpartitioning\(text_id[^)]*\), (\w+)", plan(QUERIES["c5_encode_for_training"](spark, SF)))) == {"REPARTITION_BY_NUM"}


def test_coverage_joins_distinct_words_only(spark):
    assert "inline" not in plan(QUERIES["a8_coverage"](spark, SF))


def test_a_block_is_parsed_once_for_its_words(spark):
    b = spark.createDataFrame([("<sml>\nE(0|0|0|0|X0|0|0|0.9)\nR(IsA|0|7|0.50|0|0)\n</sml>",)], "b string")
    assert plan(b.select(codec.in_words(F.col("b")))).count("regexp_extract_all") <= 4  # a plan says each projection twice
    q = b.select(codec.question_in_words(F.concat("b", F.lit("\n\nIs the SML data so?"))).alias("q"))
    assert plan(q).count("regexp_extract_all") <= 4
    assert q.first()["q"].endswith("Relationships:\n- X0 is a type of E7 (confidence: 0.5)\n\nIs the data above so?")


def test_token_report_finds_a_block_once(spark):
    q = spark.createDataFrame([(1, "<sml>\nE(0|0|0|0|X0|0|0|0.9)\n</sml>\n\nWhat?"), (2, "none")], "line long, question string")
    r = evaluation.token_report(evaluation.paired(q, q))
    assert plan(r).count("<sml>.*?</sml>") <= 2 and r.first()["n"] == 1


def test_anchors_of_a_record_are_told_apart_in_its_row(spark):
    turn = lambda x: [("system", "s"), ("user", "u"), ("assistant", x)]
    df = spark.createDataFrame([(1, turn("<sml>\nE(0|0|0|0|b|0|0|0.9)\nE(0|0|0|0|a|0|0|0.9)\nE(0|0|0|0|b|0|0|0.9)\n</sml><think>x</think><response>y</response>"))], "line long, messages array<struct<role: string, content: string>>")
    out = records.v1_errors(df, spark.createDataFrame([("z",)], "anchor_token string"))
    assert out.first()["errors"] == ["anchor 'a' not in graph", "anchor 'b' not in graph"]
    assert not re.search(r"hashpartitioning\(line#\d+L, anchor_token|hashpartitioning\(anchor_token#\d+, line", plan(out))


def test_admission_reads_its_rows_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(100).withColumn("quality", F.when(F.col("id") % 10 == 0, "thin").otherwise("rich")).mapInPandas(counted, "id long, quality string")
    assert kg.admitted(rows, "quality", "id", 100).count() == 100 and seen.value <= 200


def test_threshold_members_meet_in_a_row(spark):
    e = spark.createDataFrame([(1, 0, "IsA", 0, 1, 0.9), (1, 1, "IsA", 1, 2, 0.1)], "graph_id long, seq long, rel_type string, src long, tgt long, weight double")
    n = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "graph_id long, idx long")
    out = questions.threshold_members(e, n.select("graph_id", F.col("idx").alias("start")), n, 0.5)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 1, True), (1, 0, 2, False), (1, 1, 0, False), (1, 1, 2, False), (1, 2, 0, False), (1, 2, 1, False)]
    twice = questions.threshold_members(e, n.select("graph_id", F.col("idx").alias("start")), n.union(n.filter("idx = 1")), 0.5)
    assert sorted(r["node"] for r in twice.filter("start = 0").collect()) == [1, 1, 2]
    assert not re.search(r"hashpartitioning\(graph_id#\d+L, start#\d+L, node", plan(out))


def rich_graph(spark):
    e = spark.createDataFrame([(1, 2, 5, 0.9), (1, 3, 4, 0.8), (1, 4, 6, 0.7), (2, 3, 4, 0.6)], EDGE)
    return spark.createDataFrame([(1,)], "id long"), e


def test_denied_edges_are_ranked_in_parts_by_size(spark):
    rich, e = rich_graph(spark)
    out = clusters.denied(rich, e, clusters.CAPABLE, None)
    assert "REPARTITION_BY_NUM" in plan(out)
    assert sorted(tuple(r["concepts"]) for r in out.collect()) == [(1, 2, 3), (1, 2, 4)]


def test_chosen_clusters_are_written_once(spark):
    rich, e = rich_graph(spark)
    for out in (clusters.grounding(rich, e, 3), clusters.denied(rich, e, clusters.CAPABLE, 1), clusters.two_hop(kg.two_hop_chains(e), 1)):
        assert "TakeOrderedAndProject" not in plan(out)


def test_pairs_of_a_text_need_no_join_by_text(spark):
    texts = spark.createDataFrame([(7, [1, 3, 2]), (8, [9, 9])], "text_id long, ids array<long>")
    out = encoder.pair_relations(texts, rich_graph(spark)[1].union(spark.createDataFrame([(9, 9, 1, 0.5), (9, 9, 2, 0.5), (3, 1, 1, 0.4)], EDGE)))
    assert sorted(map(tuple, out.collect())) == [(7, 0, 1, 4, 0.8), (7, 0, 2, 5, 0.9), (7, 1, 0, 1, 0.4), (7, 2, 1, 4, 0.6), (8, 0, 1, 1, 0.5), (8, 1, 0, 1, 0.5)]
    assert not re.search(r"Join \[text_id", plan(out))


def test_said_relations_need_no_exchange(spark):
    assert not re.search(r"Exchange hashpartitioning\(text_id", plan(QUERIES["c3_said_relations"](spark, SF)))
