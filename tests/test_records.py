"""Codec, text rules, record validators, graph building and streaming on small rows."""

import gzip
import json

from pyspark.sql import functions as F

from lattica.functions import codec, text
from lattica.operators import kg, records, search
from lattica.sources import knowledge
from lattica.streaming import ingest

BLOCK = "<sml>\nE(1|0|0|0|dog_1|0|0|0.9)\nE(1|0|0|0|cat_2|0|0|0.8)\nR(IsA|0|1|0.85|0|0)\n</sml>"
THINK = "the dog_1 IsA " + "word " * 60


def one(spark, expr, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(expr.alias("x")).first()["x"]


def test_format(spark):
    assert one(spark, codec.format_eda(*(F.lit(x) for x in (1, 2, 3, 4, "dog_1", None, "0", 0.5)))) == "E(1|2|3|4|dog_1|0|0|0.5)"
    assert one(spark, codec.format_ra(F.lit("20"), F.lit(0), F.lit(1), F.lit(0.5), F.lit(0), F.lit(True))) == "R(NOT_HasContext|0|1|0.5|0|0)"
    assert one(spark, codec.format_ra(F.lit("Eats"), F.lit(0), F.lit(1), F.lit(0.5), F.lit(0), F.lit(False))) == "R(Eats|0|1|0.5|0|0)"


def test_question_in_words(spark):
    q = f"Based on the SML data, what is it?\n{BLOCK}".replace("dog_1", "X0")
    out = one(spark, codec.question_in_words(F.col("q")), q=q)
    assert "Based on the data above, what" in out and "X0 is a type of cat_2 (confidence: 0.85)" in out and "<sml>" not in out
    assert one(spark, codec.question_in_words(F.lit("no block"))) == "no block"


def test_text_rules(spark):
    assert one(spark, text.block_quality(F.lit(BLOCK))) == "rich"
    assert one(spark, text.block_quality(F.lit("<sml>\nE(0|0|0|0|unknown_x|0|0|0.3)\n</sml>"))) == "unknown"
    assert one(spark, text.block_quality(F.lit("<sml>\nE(0|0|0|0|dog_1|0|0|0.3)\n</sml>"))) == "thin"
    assert one(spark, text.clean_response(F.lit("The dog_2451 (IsA) is in  the SML block."))).split() == ["The", "is", "in", "the", "."]
    assert one(spark, text.question_error(F.lit("Why?"))) == "too short (4 chars)"
    assert one(spark, text.question_error(F.lit("What colour is the dog?"))) is None
    assert one(spark, text.question_error(F.lit("What does IsA mean here?"))) == "contains relation name 'IsA'"
    assert one(spark, text.answer_error(F.lit("It cannot be determined from this."))) == "punt response"
    assert one(spark, text.reasoning_error(F.lit(THINK), F.array(F.lit("dog_1")))) is None
    assert one(spark, text.reasoning_error(F.lit(THINK), F.array(F.lit("cow_3")))) == "does not reference any anchor"
    assert one(spark, text.asked_category(F.lit("Is it light?"))) == 6
    assert one(spark, text.property_category(F.lit("Crimson"), F.lit(""))) == 1
    assert one(spark, text.property_category(F.lit("x"), F.lit("having a strong taste"))) == 9
    assert one(spark, text.english_term(F.lit("/c/en/hot_dog/n"))) == "hot dog"
    assert one(spark, text.english_term(F.lit("/c/fr/chien"))) is None
    assert one(spark, text.json_weight(F.lit("{bad"))) == 0.0
    assert one(spark, text.anchor_token(F.lit("Hot-Dog é!"), F.lit(7))) == "hot_dog_é_7"


def test_parse_teacher(spark):
    p = lambda t: tuple(one(spark, text.parse_teacher(F.lit(t))))
    assert p("<think>a</think><response>b</response>") == ("a", "b")
    assert p("<think>a</think> rest") == ("a", "rest")
    assert p("l1\nl2\nl3\nl4") == ("l1\nl2", "l3\nl4")
    assert p("short") == ("", "")


def test_scores(spark):
    s = lambda r, t, k, a: one(spark, text.score(F.lit(r), F.lit(t), k, a))
    arr = lambda *w: F.array(*(F.lit(x) for x in w))
    none = F.lit(None).cast("array<string>")
    assert s("Red", "", arr("red"), none) == "PASS"
    assert s("blue", "red", arr("red"), none) == "PARTIAL"
    assert s("red blue", "", arr("red"), arr("blue")) == "FAIL"
    assert s("x", "", none, none) == "PASS" and s("", "", none, none) == "FAIL"


def v3(user=f"{BLOCK}\n\nWhat is it?", reply=f"<think>{THINK}</think>\nIt is a kind of animal that barks."):
    return [("system", "s"), ("user", user), ("assistant", reply)]


def test_record_errors(spark):
    cases = [v3(), v3()[:2], v3(user="no block?"), v3(user=BLOCK.replace("|0|1|0.85", "|0|5|0.85") + "?"), v3(reply="<think>short</think> tiny"), v3(user=BLOCK.replace("|0.9)", ")") + "?")]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, messages array<struct<role:string,content:string>>")
    got = {r["i"]: r["e"] for r in df.select("i", text.record_errors(F.col("messages")).alias("e")).collect()}
    assert got[0] == [] and got[1] == ["expected 3 messages, got 2"]
    assert "user message missing block" in got[2] and got[3] == ["target ref out of range"] and "entity width is not 8" in got[5]
    assert "think block too short (1 words)" in got[4] and "answer too short (4 chars)" in got[4]


def test_v1_errors_and_conversion(spark):
    reply = f"{BLOCK}<think>{THINK}</think><response>It is an animal.</response>"
    cases = [(1, [("system", "s"), ("user", "q?"), ("assistant", reply)]), (2, [("system", "s"), ("user", "q?"), ("assistant", reply.replace("cat_2", "cow_9"))]), (3, [("user", "q?")]), (4, None)]
    df = spark.createDataFrame(cases, "line long, messages array<struct<role:string,content:string>>")
    concepts = spark.createDataFrame([("dog_1",), ("cat_2",)], "anchor_token string")
    got = {r["line"]: r["errors"] for r in records.v1_errors(df, concepts).collect()}
    assert got == {1: [], 2: ["anchor 'cow_9' not in graph"], 3: ["need at least 3 messages"], 4: ["missing messages"]}
    s = records.validation_summary(records.v1_errors(df, concepts)).first()
    assert (s["total"], s["valid"], s["invalid"], s["valid_pct"]) == (4, 1, 3, 25.0)
    new = {r["line"]: r["m"] for r in df.select("line", text.convert_record(F.col("messages"), "p").alias("m")).collect()}
    assert new[1][1]["content"] == f"{BLOCK}\n\nq?" and new[1][2]["content"].endswith("It is an animal.") and new[3] is None and new[4] is None


def test_build_graph(spark, tmp_path):
    lines = ["\t".join(("u", r, a, b, m)) for r, a, b, m in [("/r/IsA", "/c/en/dog", "/c/en/animal", '{"weight": 2.0}'), ("/r/HasProperty", "/c/en/dog", "/c/en/red", '{"weight": 30}'), ("/r/IsA", "/c/fr/chien", "/c/en/dog", '{"weight": 2.0}'), ("/r/IsA", "/c/en/cat", "/c/en/animal", '{"weight": 0.5}'), ("/r/Nope", "/c/en/a", "/c/en/b", '{"weight": 2}'), ("/r/IsA", "/c/en/a", "/c/en/b", "bad")]] + ["too\tshort"]
    path = tmp_path / "a.tsv.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    rel = knowledge.english_relations(knowledge.read_assertions(spark, str(path)))
    concepts, edges = knowledge.build_graph(rel)
    c = {r["surface_text"]: r for r in concepts.collect()}
    assert {k: v["id"] for k, v in c.items()} == {"dog": 1, "animal": 2, "red": 3} and c["red"]["anchor_token"] == "red_3" and (c["red"]["domain"], c["red"]["category"]) == (4, 1)
    assert sorted((r["source_id"], r["target_id"], r["weight"]) for r in edges.collect()) == [(1, 2, 0.2), (1, 3, 1.0)]
    assert knowledge.build_graph(rel, 2)[1].count() == 1
    more = knowledge.insert_new(concepts, concepts.withColumn("definition", F.lit("x")), "id", "id")
    assert more.count() == 3


def test_taxonomy(spark):
    h = spark.createDataFrame([("dog", "canine", 0), ("dog", "pet", 1), ("canine", "animal", 0), ("animal", "thing", 0)], "term string, parent string, pos int")
    roots = spark.createDataFrame([("animal", 1, 3, 0), ("canine", 1, 0, 7)], "term string, domain int, category int, subcategory int")
    got = {r["text"]: (r["domain"], r["category"], r["subcategory"], r["specificity"]) for r in knowledge.hypernym_taxonomy(h, roots).collect()}
    assert got["dog"] == (1, 3, 7, 2) and got["animal"] == (0, 0, 0, 0)


def test_records_files_and_results(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text(json.dumps({"messages": [{"role": "user", "content": "x"}]}) + "\n\nnot json\n")
    assert sorted(r["valid"] for r in knowledge.read_records(spark, str(p)).collect()) == [False, True]
    for i, name in enumerate(("a", "b")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(json.dumps({"results": {"task": i}}))
    assert knowledge.latest_results(spark, str(tmp_path), "task").count() == 1
    knowledge.write_records(spark.range(10), str(tmp_path / "out"), None)
    assert spark.read.json(str(tmp_path / "out")).count() == 10


def test_search_and_quota(spark):
    n = spark.createDataFrame([(1, "hot dog"), (2, "dog house"), (3, "hot doghouse")], "id long, surface_text string")
    posts = search.postings(n, "surface_text")
    assert [r["id"] for r in search.search(posts, "hot DOG").orderBy("rank").collect()] == [1, 3]
    assert search.search(posts, "!!").count() == 0
    pool = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 100)], "category string, key long")
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "category string, share double")
    got = records.quota_sample(pool, shares, 8, 1).collect()
    assert len(got) == 8 and sum(r["category"] == "b" for r in got) == 1
    assert records.quota_sample(pool, shares, 30, 1).count() == 30
    assert records.quota_sample(pool.limit(0), shares, 3, 1).count() == 0


def test_admission(spark):
    rows = spark.createDataFrame([(i, "thin") for i in range(50)] + [(i, "rich") for i in range(50, 60)], "i int, quality string")
    got = kg.admitted(rows, "quality", "i", 60).groupBy("quality").count().collect()
    assert {r["quality"]: r["count"] for r in got} == {"thin": 12, "rich": 10}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"messages": [{"role": r, "content": c} for r, c in v3()]}
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(good) + "\n" + json.dumps({"messages": []}) + "\n")
    q = ingest.write_valid(ingest.record_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    n = spark.createDataFrame([(1, "hot dog")], "id long, surface_text string")
    n.write.parquet(str(tmp_path / "n"))
    s = spark.readStream.schema(n.schema).parquet(str(tmp_path / "n"))
    ingest.upsert_postings(s, str(tmp_path / "posts"), str(tmp_path / "ck2")).awaitTermination(60)
    found = lambda: sorted((r["token"], r["id"]) for r in ingest.current_postings(spark, str(tmp_path / "posts")).collect())
    assert found() == [("dog", 1), ("hot", 1)]
    spark.createDataFrame([(1, "cold cat"), (2, "old dog")], "id long, surface_text string").write.mode("append").parquet(str(tmp_path / "n"))
    ingest.upsert_postings(s, str(tmp_path / "posts"), str(tmp_path / "ck2")).awaitTermination(60)
    assert found() == [("cat", 1), ("cold", 1), ("dog", 2), ("old", 2)]
    spark.createDataFrame([(1, None)], "id long, surface_text string").write.mode("append").parquet(str(tmp_path / "n"))
    ingest.upsert_postings(s, str(tmp_path / "posts"), str(tmp_path / "ck2")).awaitTermination(60)
    assert found() == [("dog", 2), ("old", 2)]
    ingest.compacted(spark, str(tmp_path / "posts"), str(tmp_path / "small"))
    assert ingest.current_postings(spark, str(tmp_path / "small")).count() == 2
