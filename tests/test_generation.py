"""Clusters, encoding, question graphs, prompts, the store, generation and evaluation on small rows."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.config import Settings
from lattica.functions import tokens
from lattica.operators import clusters, encoder, evaluation, generation, graph, kg, prompts, questions, search
from lattica.shared import numbered
from lattica.sources import store

CONCEPT = "id long, surface_text string, anchor_token string, domain int, category int, subcategory int, specificity int"
EDGE = "source_id long, target_id long, relation_type_id int, weight double"


def concept_rows(spark, *names, domain=1, category=2):
    return spark.createDataFrame([(i, n, f"{n.replace(' ', '_')}_{i}", domain, category, 0, 0) for i, n in enumerate(names, 1)], CONCEPT)


def test_numbered_is_dense_and_ordered(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("k")).repartition(7)
    got = sorted((r["n"], r["k"]) for r in numbered(df, F.col("k")).collect())
    assert got == [(i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0), F.col("k")).count() == 0


def test_thirds_and_shares():
    assert clusters.thirds(8) == (3, 3, 2) and clusters.thirds(1) == (1, 1, 1) and clusters.thirds(9) == (3, 3, 3)
    assert clusters.category_counts(101, {"A": 50, "B": 20, "C": 20, "D": 10}) == {"A": 50, "B": 20, "C": 20, "D": 11}


def test_cluster_blocks(spark):
    c = concept_rows(spark, "dog", "bark", "red")
    e = spark.createDataFrame([(1, 3, 4, 0.7), (1, 2, 5, 0.4)], EDGE)
    rel = [(1, 2, 5, 0.4, False), (1, 2, 5, 0.9, True), (1, 3, 4, 0.3, False)]
    cl = spark.createDataFrame([("A", "k", 1, [1, 2, 3], rel, "")], f"category string, cluster string, seed_id long, concepts array<long>, relations array<{clusters.RELATION}>, note string")
    block = clusters.cluster_blocks(cl, c, e).first()["block"]
    # the negated relation is the heavier of two alike, and stays at the first one's place
    assert block == "<sml>\nE(1|2|0|0|dog_1|red_3|0|0.9)\nE(1|2|0|0|bark_2|0|0|0.9)\nE(1|2|0|0|red_3|0|0|0.5)\nR(NOT_CapableOf|0|1|0.9|0|0)\nR(HasProperty|0|2|0.3|0|0)\n</sml>"
    assert clusters.facts(cl, c).first()["truth"] == "dog CapableOf bark; dog NOT_CapableOf bark; dog HasProperty red."


def test_invented_clusters_need_two_concepts(spark):
    rich = spark.createDataFrame([(1,)], "id long")
    assert clusters.invented(rich, spark.createDataFrame([], EDGE), 5).count() == 0


TOKENS = "text_id long, i int, text string, lemma string, pos string, dep string, head int, chunk int, root boolean, tense string"


def test_encode(spark):
    c = concept_rows(spark, "dog", "park", "brown", "chase", "cat")
    e = spark.createDataFrame([(1, 5, 24, 0.61), (1, 3, 4, 0.9)], EDGE)
    parse = [
        (1, 0, "The", "the", "DET", "det", 2, 0, False, None), (1, 1, "brown", "brown", "ADJ", "amod", 2, 0, False, None), (1, 2, "dog", "dog", "NOUN", "nsubj", 3, 0, True, None), (1, 3, "chased", "chase", "VERB", "ROOT", 3, None, False, "Past"),
        (1, 4, "cats", "cat", "NOUN", "dobj", 3, 1, True, None), (1, 5, "in", "in", "ADP", "prep", 3, None, False, None), (1, 6, "park", "park", "NOUN", "pobj", 5, 2, True, None),
        (2, 0, "Qqqq", "qqqq", "NOUN", "ROOT", 0, None, False, None),
        (3, 0, "dog", "dog", "NOUN", "ROOT", 0, None, False, None), (3, 1, "cat", "cat", "NOUN", "conj", 0, None, False, None),
    ]
    texts = spark.createDataFrame([(1, "The brown dog chased cats in park"), (2, "Qqqq only"), (3, "dog cat"), (4, "")], "text_id long, text string")
    got = {r["text_id"]: r["block"].split("\n")[1:-1] for r in encoder.encode(texts, spark.createDataFrame(parse, TOKENS), c, e, search.postings(c, "surface_text")).collect()}
    assert got[1] == ["E(1|2|0|0|dog_1|brown_3|0|0.9)", "E(1|2|0|0|cat_5|0|0|0.9)", "E(1|2|0|0|park_2|0|0|0.9)", "E(1|2|0|0|chase_4|0|0|0.85)", "R(AtLocation|0|1|0.85|1|0)"]
    assert got[2] == ["E(0|0|0|0|unknown_qqqq_only|0|0|0.3)"] and got[4] == ["E(0|0|0|0|unknown_|0|0|0.3)"]
    assert got[3] == ["E(1|2|0|0|dog_1|0|0|0.9)", "E(1|2|0|0|cat_5|0|0|0.9)", "R(RelatedTo|0|1|0.61|0|0)"]


def test_encoding_sends_no_token_through_an_exchange_by_text(spark):
    c = concept_rows(spark, "dog", "park")
    e = spark.createDataFrame([(1, 2, 6, 0.61)], EDGE)
    token = "struct<i: int, text: string, lemma: string, pos: string, dep: string, head: int, chunk: int, root: boolean, tense: string>"
    rows = [(i, "dog in park", [(0, "dog", "dog", "NOUN", "ROOT", 0, 0, True, None), (1, "in", "in", "ADP", "prep", 0, None, False, None), (2, "park", "park", "NOUN", "pobj", 1, 1, True, None)]) for i in range(50)]
    parse = spark.createDataFrame(rows, f"text_id long, text string, tokens array<{token}>").repartition(3, "text_id")
    out = encoder.encode_folded(parse, c, e, search.postings(c, "surface_text"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # dealt once by the caller; joins with known words and edges are broadcasts
    assert set(re.findall(r"Exchange (\w+)\((?:text_id[^)]*|word[^)]*)\), (\w+)", plan)) == {("hashpartitioning", "REPARTITION_BY_NUM")}
    assert {r["block"] for r in out.collect()} == {"<sml>\nE(1|2|0|0|dog_1|0|0|0.9)\nE(1|2|0|0|park_2|0|0|0.9)\nR(AtLocation|0|1|0.61|0|0)\n</sml>"}


def test_resolve_in_turn(spark):
    c = concept_rows(spark, "dog", "hot dog", "doghouse")
    words = spark.createDataFrame([("Dog", "dog", [1.0, 0.0]), ("dogs", "dog", [1.0, 0.0]), ("dogh", "dogh", [1.0, 0.0]), ("hot", "hot", [1.0, 0.0]), ("the", "the", [1.0, 0.0]), ("zzz", "zzz", [1.0, 0.0])], "word string, lemma string, vector array<double>")
    posts = search.postings(c, "surface_text")
    plain = {r["word"]: r["id"] for r in encoder.resolve(words, c, posts).collect()}
    assert plain == {"dog": 1, "dogs": 1, "dogh": 3, "hot": 2}
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0])], "id long, v array<double>")
    do = spark.createDataFrame([("do", "do", [1.0, 0.0])], "word string, lemma string, vector array<double>").withColumn("word", F.lit("dog")).withColumn("lemma", F.lit("x"))
    near = encoder.resolve(do.withColumn("word", F.lit("do" + "g")), c.filter("id > 1"), search.postings(c.filter("id > 1"), "surface_text"), vectors).collect()
    assert [r["id"] for r in near] == [3]


def test_graph_builder(spark):
    g = spark.range(1).select(F.col("id").alias("graph_id"), questions.add_chain(questions.add_entities(questions.empty_graph(), 1), F.array(F.lit("IsA"), F.lit("Causes")), None, F.lit(0)).alias("c"))
    entities, edges = questions.rows(g.select("graph_id", F.col("c.graph").alias("graph")))
    assert [r["idx"] for r in entities.collect()] == [0, 1, 2]
    assert [tuple(r)[1:] for r in edges.collect()] == [(0, "IsA", 0, 1, 0.85), (1, "Causes", 1, 2, 0.85)]
    branch = questions.add_branch(F.col("c.graph"), F.lit(1), F.lit(3), F.array(F.lit("PartOf")), F.array(F.lit(0.4)))
    b = g.select(branch.alias("b")).first()["b"]
    assert list(b["nodes"]) == [3, 4, 5] and [r["weight"] for r in b["graph"]["relations"]][2:] == [0.4, 0.7, 0.7]
    with pytest.raises(PySparkException):
        g.select(questions.add_chain(F.col("c.graph"), F.array(F.lit("IsA")), F.array(F.lit(0.1), F.lit(0.2)))).collect()


def test_questions_are_right(spark):
    q = questions.chain_questions(spark.range(20).select(F.col("id").alias("graph_id")), 3).collect()
    ends = {r["graph_id"]: f"X{r['end']}" for r in questions.chain_graphs(spark.range(20).select(F.col("id").alias("graph_id")), 3).collect()}
    for r in q:
        assert r["choices"][r["answer"]] == ends[r["graph_id"]] and len(set(r["choices"])) == 4 and f"{'ABCD'[r['answer']]}) {ends[r['graph_id']]}" in r["question"]


def test_closure_of_large_graphs_is_the_same(spark, monkeypatch):
    e = spark.createDataFrame([(g, i, "IsA", i % 7, (i * 3) % 7, 0.9) for g in (1, 2) for i in range(9)] + [(3, 0, "IsA", 1, 1, 0.9)], "graph_id long, seq long, rel_type string, src long, tgt long, weight double")
    s = spark.createDataFrame([(g, n) for g in (1, 2, 3, 4) for n in range(7)], "graph_id long, start long")
    small = sorted(map(tuple, graph.reachable(e, s).collect()))
    monkeypatch.setattr(graph, "FOLDED", 0)
    assert sorted(map(tuple, graph.reachable(e, s).collect())) == small and small


def test_scenes_fall_back_to_known_places(spark):
    pairs = spark.createDataFrame([("dog", "brown", 1), ("cat", "old", 1)], "entity string, property string, category int")
    places = spark.createDataFrame([("dog", "park")], "entity string, location string")
    assert {r["prompt"] for r in prompts.scene_prompts(pairs, places, ("{adj} {entity} at {location}",), 1).collect()} == {"brown dog at park", "old cat at park"}
    none = places.limit(0)
    assert {r["prompt"] for r in prompts.scene_prompts(pairs, none, ("{adj} {entity} at {location}",), 1).collect()} == {"brown dog at a room", "old cat at a room"}


def test_store(spark, tmp_path):
    c = concept_rows(spark, "dog", "cat")
    r = store.with_edge_ids(spark.createDataFrame([(2, 1, 1, 0.5), (1, 2, 1, 0.4)], EDGE), F.col("source_id"))
    s = store.append_relations(store.Store(c, r), spark.createDataFrame([(1, 1, 2, 0.3)], EDGE), F.col("source_id"))
    store.replace_store(s, str(tmp_path / "g"))
    store.replace_store(s, str(tmp_path / "g"))
    back = store.open_store(spark, str(tmp_path / "g"))
    assert sorted((x["id"], x["source_id"]) for x in back.relations.collect()) == [(1, 1), (2, 2), (3, 1)] and back.concepts.count() == 2


def test_store_from_fixture(spark):
    c = spark.createDataFrame([(0, "dog", 1, 1, 0, 0), (2, "hot dog", 1, 5, 0, 0)], "line long, surface_text string, domain int, category int, subcategory int, specificity int")
    e = spark.createDataFrame([(0, "hot dog", "IsA", "dog", 0.9), (1, "dog", "Nope", "dog", 0.9), (2, "dog", "HasContext", "cat", 0.9), (3, "dog", "HasContext", "hot dog", 0.5)], "line long, source string, label string, target string, weight double")
    s = store.from_fixture(c, e, kg.relation_types(spark))
    assert sorted((r["id"], r["anchor_token"]) for r in s.concepts.collect()) == [(1, "dog_1"), (2, "hot_dog_2")]
    assert sorted(map(tuple, s.relations.collect())) == [(1, 2, 1, 1, 0.9), (2, 1, 2, 30, 0.5)]


def test_token_counts(spark):
    texts = ["a b c", "", None, "some longer text here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = {r["i"]: r["n"] for r in df.select("i", tokens.token_counter(None)(F.col("t")).alias("n")).collect()}
    assert plain == {0: 1, 1: 0, 2: None, 3: 5}
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    got = {r["i"]: r["n"] for r in df.select("i", tokens.token_counter(path)(F.col("t")).alias("n")).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert got == {i: None if x is None else len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_question_files(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text('{"question": "q1", "choices": ["x", "y"], "answer": 1}\n\n{"question": "q2", "choices": ["x"], "answer": 0}\n')
    b.write_text('{"question": "w1"}\n\n{"question": "w2"}\n')
    x, y = (evaluation.questions(store.numbered_lines(spark, str(f))) for f in (a, b))
    got = sorted((r["line"], r["a"]["question"], r["b"]["question"]) for r in evaluation.paired(x, y).collect())
    assert got == [(0, "q1", "w1"), (2, "q2", "w2")]
    with pytest.raises(ValueError):
        evaluation.paired(x, y.limit(1))


def test_retries():
    waits, tries = [], []

    def call(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError
        return x.upper()

    assert generation.with_retries(call, 5, 1.0, 60.0, waits.append)("a") == "A" and 1 <= waits[0] <= 1.5 and 2 <= waits[1] <= 3
    assert generation.with_retries(lambda x: 1 / 0, 2, 1.0, 60.0, waits.append)("a") is None


def test_completed(spark):
    r = spark.createDataFrame([("a",), ("b",), ("a",)], "request string")
    assert sorted(map(tuple, generation.completed(r, lambda x: x + "!" if x == "a" else 1 / 0, 1).collect())) == [("a", "a!"), ("b", None)]


def test_summary_file(spark, tmp_path):
    generation.write_summary(spark, {"b": 1, "a": 2}, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()["value"] == '{"a": 2, "b": 1}'


def test_settings():
    assert Settings.read({}) == Settings() and Settings.read({"LATTICA_RETRIES": "2"}).retries == 2
