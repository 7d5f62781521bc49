"""Registered queries of the store, of record building and validation, and of question sets and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import codec, text
from lattica.operators import clusters, encoder, evaluation, generation, kg, records, search
from lattica.plans.cluster_queries import C_SQL, COUNTS, SEED, cut, true_edges
from lattica.plans.queries import BLOCKS, WORDS_SQL, blocks, has_sql, query
from lattica.plans.question_queries import hexed, listed
from lattica.plans.text_queries import SENTENCES, parsed
from lattica.schemas import URI_TO_ID
from lattica.sources import knowledge, store
from lattica.sources.tables import concepts, edges, nodes, table

c = F.col
NL = "chr(10)"
URI_OF = {i: u for u, i in URI_TO_ID.items()}

# ---------------------------------------------------------------- the store

CON = r", con AS (SELECT id, surface_text, domain, category, regexp_replace(replace(replace(lower(surface_text), ' ', '_'), '-', '_'), '[^\p{L}\p{N}_]', '', 'g') || '_' || id AS anchor_token FROM nodes)"


@query("p2_lookup_by_anchor", CON + ", ask AS (SELECT DISTINCT lower(replace(c_name, '#', '')) || '_' || (5000000 + c_custkey + c_custkey % 2) AS anchor_token FROM customer) SELECT ask.anchor_token, id, domain, category FROM ask JOIN con USING (anchor_token)")
def p2_lookup_by_anchor(s, d):
    asked = table(s, d, "customer").select(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("_"), (5000000 + c("c_custkey") + c("c_custkey") % 2).cast("string")).alias("anchor_token")).distinct()
    return store.by_anchor(concepts(s, d), asked).select("anchor_token", "id", "domain", "category")


@query("p4_taxonomy", "SELECT a.id, coalesce(domain, -1) AS domain, coalesce(category, -1) AS category, CASE WHEN domain IS NOT NULL THEN 0 ELSE -1 END AS subcategory, CASE WHEN domain IS NOT NULL THEN 0 ELSE -1 END AS specificity FROM (SELECT 4000000 + p_partkey AS id FROM part UNION ALL SELECT 9000000 + p_partkey FROM part) a LEFT JOIN nodes USING (id)")
def p4_taxonomy(s, d):
    """Half of the ids asked for don't exist: -1."""
    p = table(s, d, "part")
    asked = p.select((4000000 + c("p_partkey")).cast("long").alias("id")).union(p.select(9000000 + c("p_partkey")))
    return store.taxonomy(concepts(s, d), asked).na.fill(-1)


@query("p12_slices", "SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN domain IN (1, 2) THEN 'entity' END, CASE WHEN domain = 3 THEN 'action' END, CASE WHEN domain = 4 THEN 'property' END, CASE WHEN domain = 1 AND category = 4 THEN 'place' END], lambda x: x IS NOT NULL)) AS kind FROM nodes) GROUP BY kind")
def p12_slices(s, d):
    return store.slices(nodes(s, d)).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("k3_edge_ids", "SELECT source_id, target_id, relation_type_id, negated, row_number() OVER (ORDER BY source_id, target_id, relation_type_id, negated) AS id FROM edges")
def k3_edge_ids(s, d):
    e = edges(s, d)
    return store.with_edge_ids(e, c("source_id"), c("target_id"), c("relation_type_id"), c("negated")).select("source_id", "target_id", "relation_type_id", "negated", "id")


BUILD_SQL = """, asr AS (SELECT source_id * 100 + relation_type_id AS r0, replace(a.surface_text, '_', ' ') AS source, replace(b.surface_text, '_', ' ') AS target, relation_type_id AS k, target_id, 10 * round(weight, 2) AS w FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE relation_type_id IN (1, 2, 4, 6)),
rel AS (SELECT row_number() OVER (ORDER BY r0, target_id) AS row, * FROM asr WHERE w >= 1),
fst AS (SELECT txt, row_number() OVER (ORDER BY min(pl)) AS id FROM (SELECT source AS txt, row * 2 AS pl FROM rel UNION ALL SELECT target, row * 2 + 1 FROM rel) GROUP BY txt)
"""


def assertions(s: SparkSession, d: str) -> DataFrame:
    """row, relation_uri, source_uri, target_uri, metadata: edges of four types as an importer reads them."""
    n = nodes(s, d).select("id", "surface_text")
    e = edges(s, d, (1, 2, 4, 6)).join(n.select(c("id").alias("source_id"), c("surface_text").alias("a")), "source_id").join(n.select(c("id").alias("target_id"), c("surface_text").alias("b")), "target_id")
    uri = lambda x: F.concat(F.lit("/c/en/"), F.replace(x, F.lit(" "), F.lit("_")))
    e = store.with_edge_ids(e, c("source_id") * 100 + c("relation_type_id"), c("target_id"))
    return e.select(c("id").alias("row"), codec.lookup(URI_OF, c("relation_type_id")).alias("relation_uri"), uri(c("a")).alias("source_uri"), uri(c("b")).alias("target_uri"), F.concat(F.lit('{"weight": '), (10 * F.round("weight", 2)).cast("string"), F.lit("}")).alias("metadata"))


@query("c1_graph_concepts", BUILD_SQL + r"SELECT CAST(id AS BIGINT) AS id, '/c/en/' || replace(txt, ' ', '_') AS uri, txt AS surface_text, regexp_replace(replace(replace(txt, ' ', '_'), '-', '_'), '[^\p{L}\p{N}_]', '', 'g') || '_' || id AS anchor_token FROM fst")
def c1_graph_concepts(s, d):
    """C1 with P8, P9, P10 and W4: concepts from assertions."""
    return knowledge.build_graph(knowledge.english_relations(assertions(s, d)))[0].select("id", "uri", "surface_text", "anchor_token")


@query("c1_graph_relations", BUILD_SQL + "SELECT a.id AS source_id, b.id AS target_id, k AS relation_type_id, round(least(w / 10, 1), 6) AS weight FROM rel JOIN fst a ON a.txt = source JOIN fst b ON b.txt = target")
def c1_graph_relations(s, d):
    e = knowledge.build_graph(knowledge.english_relations(assertions(s, d)))[1]
    return e.select("source_id", "target_id", "relation_type_id", F.round("weight", 6).alias("weight"))


@query("g19_taxonomy", """WITH h AS (SELECT lower(s_name) AS term, lower(n_name) AS parent FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT lower(n_name), lower(r_name) FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT lower(r_name), 'world' FROM region)
SELECT term AS text, CASE lvl WHEN 0 THEN 9 ELSE 1 END AS domain, 7 AS category, 0 AS subcategory, lvl AS specificity FROM (SELECT term, CASE WHEN parent = 'world' THEN 0 WHEN parent IN (SELECT lower(r_name) FROM region) THEN 1 ELSE 2 END AS lvl FROM h)""", views=False)
def g19_taxonomy(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    up = table(s, d, "supplier").join(n, c("s_nationkey") == c("n_nationkey")).select(F.lower("s_name").alias("term"), F.lower("n_name").alias("parent"))
    up = up.union(n.join(r, c("n_regionkey") == c("r_regionkey")).select(F.lower("n_name"), F.lower("r_name"))).union(r.select(F.lower("r_name"), F.lit("world")))
    hyper = up.withColumn("pos", F.lit(0)).union(up.select("term", F.lit("elsewhere"), F.lit(1)))
    roots = r.select(F.lower("r_name").alias("term"), F.lit(1).alias("domain"), F.lit(0).alias("category"), F.lit(0).alias("subcategory")).union(s.createDataFrame([("world", 9, 7, 0)], "term string, domain int, category int, subcategory int"))
    return knowledge.hypernym_taxonomy(hyper, roots)


# ---------------------------------------------------------------- blocks and texts


@query("f1_entity_lines", CON + "SELECT id, 'E(' || domain || '|' || category || '|0|0|' || anchor_token || '|0|0|0.9)' AS line FROM con")
def f1_entity_lines(s, d):
    return concepts(s, d).select("id", codec.format_eda(c("domain"), c("category"), c("subcategory"), c("specificity"), c("anchor_token"), F.lit(None), F.lit(0), F.lit(0.9)).alias("line"))


@query("f2_relation_lines", "SELECT 'R(' || CASE WHEN negated THEN 'NOT_' ELSE '' END || label || '|' || source_id || '|' || target_id || '|0.5|2|0)' AS line FROM edges JOIN rt ON rt.id = relation_type_id")
def f2_relation_lines(s, d):
    return edges(s, d).select(codec.format_ra(c("relation_type_id"), c("source_id"), c("target_id"), F.lit(0.5), F.lit(2), c("negated")).alias("line"))


@query("f3_blocks_of_orders", """, ln AS (SELECT l_orderkey AS k, 'E(0|0|0|0|part_' || l_partkey || '|0|0|0.9)' AS e, 'R(PartOf|0|0|0.5|0|0)' AS r FROM lineitem)
SELECT k, '<sml>' || chr(10) || string_agg(e, chr(10) ORDER BY e) || chr(10) || string_agg(r, chr(10)) || chr(10) || '</sml>' AS block FROM ln GROUP BY k""")
def f3_blocks_of_orders(s, d):
    zero = F.lit(0)
    e = codec.format_eda(zero, zero, zero, zero, F.concat(F.lit("part_"), c("l_partkey").cast("string")), zero, zero, F.lit(0.9))
    r = codec.format_ra(F.lit(2), zero, zero, F.lit(0.5), zero, F.lit(False))
    g = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(e)).alias("e"), F.collect_list(r).alias("r"))
    return g.select("k", codec.format_block(c("e"), c("r")).alias("block"))


def neutral_sql(x: str) -> str:
    for old, new in codec.NEUTRAL_WORDS:
        x = f"replace({x}, '{old}', '{new}')"
    return x


PHRASES = tuple(old for old, _ in codec.NEUTRAL_WORDS)


@query("f7_neutral_wording", f"SELECT doc_id, {neutral_sql(f'{listed(PHRASES)}[CAST(doc_id % {len(PHRASES)} AS INTEGER) + 1] || lang')} AS asked FROM documents", views=False)
def f7_neutral_wording(s, d):
    phrase = F.get(F.array(*(F.lit(p) for p in PHRASES)), (c("doc_id") % len(PHRASES)).cast("int"))
    return table(s, d, "documents").select("doc_id", codec.neutral(F.concat(phrase, c("lang"))).alias("asked"))


LEAK = r"\b[\p{L}\p{N}_]+_\p{Nd}{3,}\b"


def clean_sql(x: str) -> str:
    x = f"regexp_replace({x}, '{LEAK}', '', 'g')"
    for n in text.RELATION_NAMES:
        x = f"replace({x}, '{n}', '')"
    for p in text.REMOVED_PHRASES:
        x = f"regexp_replace({x}, '{p}', '', 'gi')"
    for p, to in text.GAPS:
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return f"trim({x})"


LEAKY = "'The dog_2451 (IsA) is \"' || role || '\" in  the SML block, with ' || lower(left(text, 40))"


@query("f8_cleaned_responses", f"SELECT conv_id, turn, {clean_sql(LEAKY)} AS cleaned FROM conversations", views=False)
def f8_cleaned_responses(s, d):
    leaky = F.concat(F.lit('The dog_2451 (IsA) is "'), c("role"), F.lit('" in  the SML block, with '), F.lower(F.substring("text", 1, 40)))
    return table(s, d, "conversations").select("conv_id", "turn", text.clean_response(leaky).alias("cleaned"))


TAGGED = ("'<think>a ' || role || '</think><response> b </response>'", "'<think>' || role || '</think> rest '", "'no tags'", "'<response>' || role || '</response>'", "'l1' || chr(10) || role || chr(10) || 'l3' || chr(10) || 'l4'")


def tagged(s: SparkSession, d: str) -> DataFrame:
    cases = (F.concat(F.lit("<think>a "), c("role"), F.lit("</think><response> b </response>")), F.concat(F.lit("<think>"), c("role"), F.lit("</think> rest ")), F.lit("no tags"), F.concat(F.lit("<response>"), c("role"), F.lit("</response>")), F.concat(F.lit("l1\n"), c("role"), F.lit("\nl3\nl4")))
    return table(s, d, "conversations").select("conv_id", "turn", F.get(F.array(*cases), (c("conv_id") % 5).cast("int")).alias("raw"))


@query("f9_teacher_responses", """SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'a ' || role WHEN 1 THEN role WHEN 4 THEN 'l1' || chr(10) || role ELSE '' END AS thinking,
CASE conv_id % 5 WHEN 0 THEN 'b' WHEN 1 THEN 'rest' WHEN 3 THEN role WHEN 4 THEN 'l3' || chr(10) || 'l4' ELSE '' END AS answer FROM conversations""", views=False)
def f9_teacher_responses(s, d):
    return tagged(s, d).select("conv_id", "turn", text.parse_teacher(c("raw")).alias("t")).select("conv_id", "turn", "t.thinking", "t.answer")


@query("f10_parsed_outputs", """SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'a ' || role WHEN 1 THEN role ELSE '' END AS thinking,
CASE conv_id % 5 WHEN 0 THEN 'b' WHEN 1 THEN 'rest' WHEN 2 THEN 'no tags' WHEN 3 THEN role ELSE 'l1' || chr(10) || role || chr(10) || 'l3' || chr(10) || 'l4' END AS response FROM conversations""", views=False)
def f10_parsed_outputs(s, d):
    return tagged(s, d).select("conv_id", "turn", generation.parsed_output(c("raw")).alias("t")).select("conv_id", "turn", "t.thinking", "t.response")


N_WORDS = r"len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''))"


@query("p17_reasoning_errors", f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'empty reasoning' WHEN {N_WORDS} < 50 THEN 'too short (' || {N_WORDS} || ' words)' WHEN NOT contains(text, 'e') THEN 'does not reference any anchor' WHEN NOT {has_sql("text", text.RELATION_NAMES)} THEN 'does not reference any relation type' END AS error
FROM (SELECT conv_id, turn, repeat(text || ' ', CAST(1 + conv_id % 9 AS INTEGER)) || CASE WHEN conv_id % 2 = 0 THEN 'IsA' ELSE '' END AS text FROM conversations)""", views=False)
def p17_reasoning_errors(s, d):
    r = F.concat(F.expr("repeat(concat(text, ' '), cast(1 + conv_id % 9 as int))"), F.when(c("conv_id") % 2 == 0, "IsA").otherwise(""))
    return table(s, d, "conversations").select("conv_id", "turn", text.reasoning_error(r, F.array(F.lit("e"))).alias("error"))


def first_form(s: SparkSession, d: str) -> DataFrame:
    """line, messages: V1 records around the blocks of the small graphs; every fourth one lacks its thinking."""
    b = blocks(s, d)
    think = F.when(c("graph_id") % 4 == 0, "").otherwise("\n<think>" + "word " * 25 + "</think>")
    turn = lambda r, x: F.struct(F.lit(r).alias("role"), x.alias("content"))
    reply = F.concat(c("block"), think, F.lit("\n<response>It is so.</response>"))
    return b.select(c("graph_id").alias("line"), F.array(turn("system", F.lit("s")), turn("user", F.lit("What is it?")), turn("assistant", reply)).alias("messages"))


def known_anchors(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(f"X{i}",) for i in range(4)], "anchor_token string")


@query("p20_first_record_errors", "SELECT o_orderkey AS line, CAST(1 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_errors FROM orders", views=False)
def p20_first_record_errors(s, d):
    """One of five anchors is unknown in every record."""
    return records.v1_errors(first_form(s, d), known_anchors(s)).select("line", F.size("errors").alias("n_errors"))


@query("a9_validation_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderkey % 4 <> 0) AS valid, count(*) FILTER (o_orderkey % 4 = 0) AS invalid, round(100.0 * count(*) FILTER (o_orderkey % 4 <> 0) / count(*), 1) AS valid_pct FROM orders", views=False)
def a9_validation_summary(s, d):
    anchors = known_anchors(s).union(s.createDataFrame([("X4",)], "anchor_token string"))
    return records.validation_summary(records.v1_errors(first_form(s, d), anchors))


@query("p22_converted_records", BLOCKS + f"""SELECT graph_id AS line, block || {NL} || {NL} || 'What is it?' AS asked, CASE WHEN graph_id % 4 = 0 THEN 'It is so.' ELSE '<think>' || {NL} || '{("word " * 25).strip()}' || {NL} || '</think>' || {NL} || {NL} || 'It is so.' END AS reply FROM bl""")
def p22_converted_records(s, d):
    m = first_form(s, d).select("line", text.convert_record(c("messages"), "s").alias("m"))
    return m.select("line", F.get("m", F.lit(1))["content"].alias("asked"), F.get("m", F.lit(2))["content"].alias("reply"))


IN_WORDS = f"""{BLOCKS}, wl AS (SELECT graph_id, string_agg('- X' || src || ' ' || {WORDS_SQL} || ' X' || tgt || ' (confidence: ' || CAST(weight AS VARCHAR) || ')', chr(10) ORDER BY seq) AS w FROM small GROUP BY graph_id),
wd AS (SELECT bl.graph_id, block, 'The following entities and relationships are defined:' || chr(10) || 'Entities: X0, X1, X2, X3, X4' || chr(10) || coalesce('Relationships:' || chr(10) || w, 'No relationships are defined.') AS words FROM bl LEFT JOIN wl USING (graph_id))
"""


@query("p23_questions_in_words", IN_WORDS + "SELECT graph_id, words || chr(10) || chr(10) || 'Based on the data above, what is X0?' AS asked FROM wd")
def p23_questions_in_words(s, d):
    """C18 too: the same question in plain words."""
    return blocks(s, d).select("graph_id", codec.question_in_words(F.concat("block", F.lit("\n\nBased on the SML data, what is X0?"))).alias("asked"))


@query("a14_token_report", IN_WORDS + """SELECT count(*) AS n, CAST(sum(length(block) // 4) AS BIGINT) AS block_tokens, CAST(sum(length(words) // 4) AS BIGINT) AS word_tokens, CAST(sum(length(block)) AS BIGINT) AS block_chars, CAST(sum(length(words)) AS BIGINT) AS word_chars,
round(avg((length(block) // 4) / (length(words) // 4)), 6) AS mean_ratio, round(sum(length(block) // 4) / sum(length(words) // 4), 6) AS ratio_of_sums FROM wd""")
def a14_token_report(s, d):
    """Blocks against words, question by question."""
    q = blocks(s, d).select(c("graph_id").alias("line"), F.concat("block", F.lit("\n\nBased on the SML data, what is X0?")).alias("question"))
    pairs = evaluation.paired(q, q.select("line", codec.question_in_words(c("question")).alias("question")))
    return evaluation.token_report(pairs).withColumns({x: F.round(x, 6) for x in ("mean_ratio", "ratio_of_sums")})


# ---------------------------------------------------------------- generation

GOOD = ("What is linked with this thing?", "word " * 60, "This is a plain answer of enough length.")


def completions(found: DataFrame, b: DataFrame) -> DataFrame:
    """Completions for clusters: by a digit of the key's hash, some lack one and some have a bad question."""
    digit = F.conv(F.substring(F.md5("cluster"), 1, 1), 16, 10).cast("int")
    x = found.select("cluster").join(b, "cluster").withColumn("digit", digit).filter("digit NOT IN (4, 5)")
    anchor = F.get(codec.strict_anchors(c("block")), F.lit(0))
    return x.select("cluster", F.when(c("digit") < 4, "Tell me about this thing").otherwise(GOOD[0]).alias("question"), F.concat(anchor, F.lit(" IsA " + GOOD[1])).alias("reasoning"), F.lit(GOOD[2]).alias("answer"), c("digit").alias("retries"))


def staged(s: SparkSession, d: str) -> DataFrame:
    e = true_edges(s, d)
    found = cut(clusters.two_hop(kg.two_hop_chains(e), COUNTS["C"], SEED))
    b = cut(clusters.cluster_blocks(found, concepts(s, d), e))
    return generation.staged_records(found.select("cluster", "category").join(b, "cluster"), completions(found, b), "s")


STAGED = C_SQL[: C_SQL.index(", mem AS (")] + """, dg AS (SELECT cluster, CAST(strpos('0123456789abcdef', md5(cluster)[1]) - 1 AS INTEGER) AS digit FROM cl),
st AS (SELECT cluster, 'C' AS category, CASE WHEN digit IN (4, 5) THEN 0 ELSE digit END AS retries, CASE WHEN digit IN (4, 5) THEN 'question: empty question' WHEN digit < 4 THEN 'question: does not end with ?' END AS error FROM dg)
"""


@query("c14_staged_records", STAGED + "SELECT cluster, category, retries, error, error IS NULL AS kept FROM st")
def c14_staged_records(s, d):
    """C14 with P16 to P19 and U4: completions come as a table."""
    return staged(s, d).select("cluster", "category", "retries", "error", c("messages").isNotNull().alias("kept"))


@query("a10_generation_stats", STAGED + "SELECT coalesce(category, 'TOTAL') AS category, count(*) FILTER (error IS NULL) AS generated, count(*) FILTER (error IS NOT NULL) AS failed, CAST(sum(retries) AS BIGINT) AS retries FROM st GROUP BY ROLLUP (category)")
def a10_generation_stats(s, d):
    return generation.generation_stats(staged(s, d))


@query("k9_manifest", STAGED + f"SELECT CAST({COUNTS['C']} AS BIGINT) AS requested, count(*) FILTER (error IS NULL) AS generated, count(*) FILTER (error IS NOT NULL) AS failed, CAST(sum(retries) AS BIGINT) AS retries FROM st")
def k9_manifest(s, d):
    m = generation.manifest(staged(s, d), {"C": COUNTS["C"]})
    return s.createDataFrame([(m["requested"]["C"], m["generated"], m["failed"], m["retries"])], "requested long, generated long, failed long, retries long")


@query("c13_first_records", BLOCKS + f"""SELECT graph_id, 'rich' AS quality, block || {NL} || '<think>' || {NL} || 't' || {NL} || '</think>' || {NL} || '<response>' || {NL} || 'It is a graph.' || {NL} || '</response>' AS reply FROM bl WHERE n_relations > 0 AND graph_id % 3 = 0
UNION ALL SELECT graph_id, 'thin', block || {NL} || '<think>' || {NL} || 't' || {NL} || '</think>' || {NL} || '<response>' || {NL} || 'It is a graph.' || {NL} || '</response>' FROM (SELECT *, row_number() OVER (ORDER BY graph_id) AS nth FROM bl WHERE n_relations = 0) WHERE graph_id % 3 = 0 AND nth <= greatest(5, CAST(floor((SELECT count(*) FROM bl) * 0.2) AS BIGINT))""")
def c13_first_records(s, d):
    """C13 with P13 to P15, F8 and F9: one completion in three gives up, one in three is missing."""
    p = blocks(s, d).withColumn("prompt", F.concat(F.lit("Describe graph "), c("graph_id").cast("string")))
    said = F.when(c("graph_id") % 3 == 0, "<think>t</think><response>It is a graph.</response>").otherwise(f"<think>t</think><response>There is {text.PUNT_PHRASES[0]}.</response>")
    r = generation.first_records(p, p.filter("graph_id % 3 <> 2").select("prompt", said.alias("completion")), "s", "graph_id")
    return r.select(F.regexp_extract("prompt", "([0-9]+)$", 1).cast("long").alias("graph_id"), "quality", F.get("messages", F.lit(2))["content"].alias("reply"))


# ---------------------------------------------------------------- question sets and scores


@query("a8_coverage", SENTENCES + "SELECT count(*) AS n_texts, 6 * count(*) AS n_tokens, 4 * count(*) AS n_known, round(100.0 * 4 / 6, 1) AS coverage_pct FROM snt")
def a8_coverage(s, d):
    """How many tokens of parsed sentences the encoder resolves."""
    texts, tokens = parsed(s, d)
    n = nodes(s, d)
    # a row for each distinct word: frequent words would else meet in one task
    words = cut(tokens.groupBy(F.lower("lemma").alias("word")).agg(F.count("*").alias("n")))
    ids = encoder.resolve(words.filter("word IS NOT NULL").select("word", c("word").alias("lemma")), n, search.postings(n, "surface_text")).select("word", "id")
    x = words.join(ids, "word", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum(F.when(c("id").isNotNull(), c("n"))), F.lit(0)).alias("n_known"))
    return x.join(texts.agg(F.count("*").alias("n_texts")), how="cross").select("n_texts", "n_tokens", "n_known", F.round(100.0 * c("n_known") / c("n_tokens"), 1).alias("coverage_pct"))


def answers(s: SparkSession, d: str) -> DataFrame:
    score = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: ((c("l_partkey") * i + c("l_suppkey")) % 11).cast("double"))
    length = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (1 + (c("l_suppkey") + i) % 5).cast("int"))
    return table(s, d, "lineitem").select(c("l_returnflag").alias("run"), c("l_orderkey").alias("question_id"), (c("l_linenumber") % 4).cast("int").alias("target"), score.alias("scores"), length.alias("lengths"))


ANSWERS = """, an AS (SELECT l_returnflag AS run, l_linenumber % 4 AS target, [CAST((l_partkey * i + l_suppkey) % 11 AS DOUBLE) for i in [1, 2, 3, 4]] AS sc, [CAST((l_partkey * i + l_suppkey) % 11 AS DOUBLE) / (1 + (l_suppkey + i) % 5) for i in [1, 2, 3, 4]] AS nm FROM lineitem),
ac AS (SELECT run, count(*) AS n, avg(CASE WHEN list_position(sc, list_max(sc)) - 1 = target THEN 1.0 ELSE 0.0 END) AS acc, avg(CASE WHEN list_position(nm, list_max(nm)) - 1 = target THEN 1.0 ELSE 0.0 END) AS acc_norm FROM an GROUP BY run)
"""


@query("a18_accuracies", ANSWERS + "SELECT run, n, round(acc, 6) AS acc, round(acc_norm, 6) AS acc_norm FROM ac")
def a18_accuracies(s, d):
    return evaluation.accuracies(answers(s, d)).withColumns({x: F.round(x, 6) for x in ("acc", "acc_norm")})


@query("a18_deltas", ANSWERS + "SELECT a.run, round(a.acc - b.acc, 6) AS delta FROM ac a, ac b WHERE b.run = 'N'")
def a18_deltas(s, d):
    return evaluation.deltas(answers(s, d), "N").select("run", F.round("delta", 6).alias("delta"))


@query("c22_bands", ANSWERS + "SELECT run, CASE WHEN acc * 100 > 70 THEN 'too easy' WHEN acc * 100 > 50 THEN 'moderate' WHEN acc * 100 > 30 THEN 'in range' ELSE 'near random' END AS band FROM ac")
def c22_bands(s, d):
    return evaluation.accuracies(answers(s, d)).select("run", evaluation.band(c("acc"), evaluation.PLAIN_BANDS, "near random").alias("band"))


@query("z14_run_matrix", "SELECT event_type AS format, round(max(CASE WHEN user_id % 2 = 0 THEN value END), 6) AS even, round(max(CASE WHEN user_id % 2 = 1 THEN value END), 6) AS odd FROM events GROUP BY event_type", views=False)
def z14_run_matrix(s, d):
    scores = table(s, d, "events").select(F.when(c("user_id") % 2 == 0, "even").otherwise("odd").alias("model"), c("event_type").alias("format"), c("value").alias("acc"))
    return evaluation.run_matrix(scores, ["even", "odd"]).select("format", F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))


@query("c21_injected_contexts", """WITH b AS (SELECT DISTINCT right(text, 64) AS snippet, 'B' || length(right(text, 64)) AS block FROM conversations WHERE length(text) % 3 > 0)
SELECT conv_id * 100 + turn AS request_id, CASE WHEN starts_with(text, 'SYS ') THEN text ELSE 'SYS ' || coalesce(block || chr(10) || chr(10), '') || text END AS context FROM conversations LEFT JOIN (SELECT snippet, max(block) AS block FROM b GROUP BY snippet) b ON b.snippet = right(text, 64)""", views=False)
def c21_injected_contexts(s, d):
    """Each distinct tail is encoded once, then the prefix and its block go before the context."""
    t = table(s, d, "conversations")
    tail = F.expr("right(text, 64)")
    b = t.filter(F.length("text") % 3 > 0).select(tail.alias("snippet")).distinct().withColumn("block", F.concat(F.lit("B"), F.length("snippet").cast("string")))
    return evaluation.injected(t.select((c("conv_id") * 100 + c("turn")).alias("request_id"), c("text").alias("context")), b, "SYS ", 64)


@query("f26_rephrased", f"""SELECT graph_id, block || {NL} || {NL} || CASE WHEN graph_id % 2 = 0 THEN 'So what is X0?' ELSE 'What is X0, then?' END || {NL} || 'A) X1' || {NL} || 'B) X2' AS question FROM bl""".join((BLOCKS, "")))
def f26_rephrased(s, d):
    """Every other new wording is not a question, so the old one stays."""
    q = F.concat(c("block"), F.lit("\n\nWhat is X0, then?\nA) X1\nB) X2"))
    new = F.when(c("graph_id") % 2 == 0, " So what is X0? ").otherwise("So X0 is it.")
    return blocks(s, d).select("graph_id", evaluation.rephrased(q, new).alias("question"))


@query("z3_has_relations", BLOCKS + "SELECT graph_id, n_relations > 0 AS has FROM bl")
def z3_has_relations(s, d):
    return blocks(s, d).select("graph_id", evaluation.has_relations(c("block")).alias("has"))


@query("z6_rendered_chats", f"""SELECT conv_id, string_agg('<|' || role || '|>' || {NL} || text || {NL}, '' ORDER BY turn) AS chat, string_agg('<|' || role || '|>' || {NL} || text || {NL}, '' ORDER BY turn) FILTER (turn < 1) AS prefix FROM conversations GROUP BY conv_id""", views=False)
def z6_rendered_chats(s, d):
    """A chat as text, and what stands before its second turn."""
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", c("text").alias("content")))).alias("m"))
    mark = F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.when(x["turn"] == 1, F.concat(F.lit("[MARK]"), x["content"])).otherwise(x["content"]).alias("content")))
    before = evaluation.system_prefix(evaluation.rendered(mark, "[TURN]<|{role}|>\n{content}\n"), "[MARK]")
    cut_turn = F.regexp_replace(F.regexp_replace(before, r"(?s)\[TURN\]<\|[^|]*\|>\n$", ""), r"\[TURN\]", "")
    return t.select("conv_id", evaluation.rendered(c("m")).alias("chat"), F.when(F.size("m") > 1, cut_turn).otherwise(evaluation.rendered(c("m"))).alias("prefix"))


@query("f22_choice_kinds", f"SELECT doc_id, {listed(('a', 'b', 'c', 'd', 'e'))}[CAST(({hexed('doc_id', 'kind').replace(chr(39) + '11:', chr(39) + '0:')}) % 5 AS INTEGER) + 1] AS kind FROM documents", views=False)
def f22_choice_kinds(s, d):
    return table(s, d, "documents").select("doc_id", evaluation.choice_kind(c("doc_id"), ("a", "b", "c", "d", "e")).alias("kind"))


@query("s11_bound_tasks", BLOCKS + "SELECT graph_id % 4 AS target, 'Q: ' || block || ' of ' || graph_id AS prompt FROM bl")
def s11_bound_tasks(s, d):
    x = blocks(s, d).withColumns({"options": F.array(F.lit("a"), F.lit("b")), "right": c("graph_id") % 4})
    return evaluation.bound(x, "Q: {{block}} of {{graph_id}}", "options", "right").select(c("target").cast("long").alias("target"), "prompt")
