"""Registered queries of question graphs, composed answers and prompt pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import graph, prompts, questions
from lattica.plans.queries import CLOSURE, query, starts
from lattica.shared import cut
from lattica.sources.tables import edges, nodes, small_edges, small_entities

#: Question graphs made, and the seed of their draws.
GRAPHS, SEED = 300, 11
c = F.col


def chain_ids(s: SparkSession) -> DataFrame:
    return s.range(GRAPHS).select(c("id").alias("graph_id"))


def h(key: str, seed: int = SEED) -> str:
    return f"((({key}) % 2147483648) * 2654435761 + {seed} * 40503) % 4294967296"


def drawn(draw: str | int, n: int, key: str = "k") -> str:
    return f"CAST({h(f'{key} * 1009 + {draw}')} % {n} AS INTEGER)"


KINDS = "[" + ", ".join(f"'{t}'" for t in questions.CHAIN_RELATIONS) + "]"
CHAINS = f"""WITH g AS (SELECT i AS k, 4 + {drawn(0, 2, "i")} AS hops, 1 + {drawn(200, 2, "i")} AS d0, 1 + {drawn(201, 2, "i")} AS d1, CASE WHEN {drawn(300, 2, "i")} = 1 THEN 1 + {drawn(202, 2, "i")} ELSE 0 END AS d2 FROM range(0, {GRAPHS}) AS r(i)),
br AS (SELECT *, CASE b WHEN 0 THEN 0 WHEN 1 THEN d0 ELSE d0 + d1 END AS prior, CASE b WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END AS dep FROM g, range(0, 3) AS x(b)),
rl AS (SELECT k, j - 1 AS seq, {KINDS}[{drawn("j * 10", 8)} + 1] AS t, j - 1 AS src, j AS tgt, ({drawn("j * 10 + 1", 36)} + 60) / 100.0 AS w FROM g, range(1, 6) AS x(j) WHERE j <= hops
UNION ALL SELECT k, hops + prior + d, {KINDS}[{drawn("d + 400 + 10 * b", 8)} + 1], CASE WHEN d = 0 THEN ({drawn(100, 97)} + 2 * b) % hops ELSE hops + prior + d END, hops + 1 + prior + d, ({drawn("d + 500 + 10 * b", 51)} + 40) / 100.0 FROM br, range(0, 2) AS x(d) WHERE d < dep)
"""


@query("g3_chain_graphs", CHAINS + "SELECT k AS graph_id, seq, t AS rel_type, CAST(src AS BIGINT) AS src, CAST(tgt AS BIGINT) AS tgt, CAST(w AS DOUBLE) AS weight FROM rl", views=False)
def g3_chain_graphs(s, d):
    """Chains and dead ends."""
    return questions.rows(questions.chain_graphs(chain_ids(s), SEED))[1]


@query("g1_chain_entities", CHAINS + "SELECT k AS graph_id, CAST(unnest(range(0, hops + 1 + d0 + d1 + d2)) AS BIGINT) AS idx, CAST(0.9 AS DOUBLE) AS conf FROM g", views=False)
def g1_chain_entities(s, d):
    return questions.rows(questions.chain_graphs(chain_ids(s), SEED))[0].select("graph_id", "idx", "conf")


@query("q7_deep_chains", CHAINS + f""", el AS (SELECT k, string_agg('E(0|0|0|0|X' || i || '|0|0|0.9)', chr(10) ORDER BY i) AS e FROM (SELECT k, unnest(range(0, hops + 1 + d0 + d1 + d2)) AS i FROM g) GROUP BY k),
bl AS (SELECT k, string_agg('R(' || t || '|' || src || '|' || tgt || '|' || printf('%.2f', w) || '|0|0)', chr(10) ORDER BY seq) AS r, string_agg(t, ' → ' ORDER BY seq) FILTER (seq = src AND tgt = src + 1 AND seq < 5) AS any_t FROM rl GROUP BY k),
ch AS (SELECT rl.k, string_agg(t, ' → ' ORDER BY seq) AS arrows, string_agg(t, ', ' ORDER BY seq) AS commas FROM rl JOIN g ON g.k = rl.k AND rl.seq < g.hops GROUP BY rl.k),
ds AS (SELECT k, list('X' || i ORDER BY hh, i)[1:3] AS ds FROM (SELECT k, i, {h("k * 1009 + i * 31")} AS hh FROM (SELECT k, hops, unnest(range(0, hops + 1 + d0 + d1 + d2)) AS i FROM g) WHERE i <> 0 AND i <> hops) GROUP BY k),
cs AS (SELECT k, list_concat(['X' || hops], ds) AS cs FROM g JOIN ds USING (k)),
mx AS (SELECT k, cs, list_sort([{{'h': {h("k * 31 + i * 7919")}, 'i': i}} for i in range(0, len(cs))]) AS m FROM cs)
SELECT k AS graph_id, '<sml>' || chr(10) || e || chr(10) || r || chr(10) || '</sml>' || chr(10) || chr(10) || CASE k % 3 WHEN 0 THEN 'Following the relation chain (' || arrows || ') starting from X0, what entity is reached at the end?'
WHEN 1 THEN 'Starting at X0, following the chain of relations (' || commas || '), what is the final entity?' ELSE 'X0 begins a chain of ' || hops || ' relations. What entity is at the terminus of this chain?' END || chr(10) || array_to_string([['A', 'B', 'C', 'D'][n] || ') ' || cs[m[n].i + 1] for n in range(1, len(m) + 1)], chr(10)) AS question,
array_to_string([cs[x.i + 1] for x in m], ',') AS choices, CAST(list_position([x.i for x in m], 0) - 1 AS INTEGER) AS answer, CAST(hops + 1 + d0 + d1 + d2 AS INTEGER) AS num_entities, CAST(hops + d0 + d1 + d2 AS INTEGER) AS num_relations, CAST(hops AS INTEGER) AS num_hops
FROM g JOIN el USING (k) JOIN bl USING (k) JOIN ch USING (k) JOIN mx USING (k)""", views=False)
def q7_deep_chains(s, d):
    """Q7 with C16, L12, F16 and Z2."""
    q = questions.chain_questions(chain_ids(s), SEED)
    return q.select("graph_id", "question", F.array_join("choices", ",").alias("choices"), "answer", "num_entities", "num_relations", "num_hops")


@query("q7_endpoints", CHAINS + "SELECT k AS graph_id, CAST(hops AS BIGINT) AS endpoint FROM g", views=False)
def q7_endpoints(s, d):
    """The solver's own way to the chains' ends: each step takes the first relation of its type."""
    g = questions.chain_graphs(chain_ids(s), SEED)
    _, e = questions.rows(g)
    first = cut(graph.first_edges(e, "rel_type", "src"))
    at = g.select("graph_id", "rel_types", c("start").alias("at"))
    for i in range(5):
        step = first.select("graph_id", c("rel_type").alias("_t"), c("src").alias("at"), c("tgt").alias("_to"))
        at = at.withColumn("_t", F.get("rel_types", F.lit(i))).join(step, ["graph_id", "_t", "at"], "left").select("graph_id", "rel_types", F.when(c("_t").isNull(), c("at")).otherwise(c("_to")).alias("at"))
    return at.select("graph_id", c("at").alias("endpoint"))


ISA = CLOSURE.format(where="rel_type = 'IsA'") + ", up AS (SELECT graph_id, start, node AS parent FROM cl WHERE node <> start), ih AS (SELECT DISTINCT up.graph_id, start, parent, p.tgt AS node, EXISTS (SELECT 1 FROM small n WHERE n.graph_id = up.graph_id AND n.src = start AND n.tgt = p.tgt AND n.rel_type = 'NOT_CapableOf') AS denied FROM up JOIN small p ON p.graph_id = up.graph_id AND p.src = parent AND p.rel_type = 'CapableOf') "


@query("q6_exceptions", ISA + "SELECT graph_id, start AS child, parent, node FROM ih WHERE denied")
def q6_exceptions(s, d):
    """Q6, inheritance with negation."""
    return questions.exceptions(small_edges(s, d))


@query("g20_inherited", ISA + "SELECT graph_id, start, node, NOT bool_or(denied) AS applies FROM ih GROUP BY ALL")
def g20_inherited(s, d):
    """G20 and Q14, inherited: what an entity denies itself overrides what it inherits."""
    return questions.inherited(small_edges(s, d))


@query("q6_strong_fanout", "SELECT graph_id, src, count(*) FILTER (weight > 0.5) AS n, arg_max(tgt, (weight, -seq)) AS best FROM small GROUP BY ALL")
def q6_strong_fanout(s, d):
    return questions.strong_fanout(small_edges(s, d))


@query("q9_threshold_members", CLOSURE.format(where="weight >= 0.75") + "SELECT a.graph_id, a.idx AS start, b.idx AS node, EXISTS (SELECT 1 FROM cl WHERE cl.graph_id = a.graph_id AND cl.start = a.idx AND cl.node = b.idx) AS member FROM ents a JOIN ents b ON a.graph_id = b.graph_id AND a.idx <> b.idx")
def q9_threshold_members(s, d):
    return questions.threshold_members(small_edges(s, d), starts(s, d), small_entities(s, d), 0.75)


@query("q5_counts", """SELECT n.graph_id, 5 AS n_entities, count(e.seq) AS n_relations, count(e.seq) FILTER (e.src = 0) AS n_out, count(DISTINCT e.rel_type) AS n_types, arg_max(g.idx, (g.degree, -g.idx)) AS most_connected, count(DISTINCT g.idx) FILTER (g.degree = 0) AS n_isolated
FROM (SELECT DISTINCT graph_id FROM ents) n LEFT JOIN small e ON e.graph_id = n.graph_id JOIN (SELECT n.graph_id, n.idx, count(*) FILTER (e.tgt = n.idx) + count(*) FILTER (e.src = n.idx) AS degree FROM ents n LEFT JOIN small e ON e.graph_id = n.graph_id GROUP BY ALL) g ON g.graph_id = n.graph_id GROUP BY n.graph_id""".replace("count(e.seq) AS n_relations, count(e.seq) FILTER (e.src = 0) AS n_out", "count(e.seq) // 5 AS n_relations, count(e.seq) FILTER (e.src = 0) // 5 AS n_out"))
def q5_counts(s, d):
    """Q5: entities, relations, out-degree of X0, types, the most connected, isolated ones."""
    e, n = small_edges(s, d), small_entities(s, d)
    totals = e.groupBy("graph_id").agg(F.count("*").alias("r"), F.count(F.when(c("src") == 0, 1)).alias("o"), F.countDistinct("rel_type").alias("t"))
    by = graph.degrees(e, n).groupBy("graph_id").agg(F.count("*").cast("int").alias("n_entities"), F.max_by("idx", F.struct(c("degree"), -c("idx"))).alias("most_connected"), F.count(F.when(c("degree") == 0, 1)).alias("n_isolated"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return by.join(totals, "graph_id", "left").select("graph_id", "n_entities", zero(c("r")).alias("n_relations"), zero(c("o")).alias("n_out"), zero(c("t")).alias("n_types"), "most_connected", "n_isolated")


@query("q11_property_counts", CLOSURE.format(where="rel_type = 'IsA'") + """SELECT n.graph_id, n.idx AS start, count(DISTINCT p.tgt) AS answer FROM ents n LEFT JOIN (SELECT cl.graph_id, cl.start, p.tgt FROM cl JOIN small p ON p.graph_id = cl.graph_id AND p.src = cl.node AND p.rel_type = 'HasProperty'
WHERE NOT EXISTS (SELECT 1 FROM small x WHERE x.graph_id = cl.graph_id AND x.src = cl.start AND x.tgt = p.tgt AND x.rel_type = 'NOT_HasProperty')) p ON p.graph_id = n.graph_id AND p.start = n.idx GROUP BY ALL""")
def q11_property_counts(s, d):
    got = graph.effective_properties(small_edges(s, d), starts(s, d)).groupBy("graph_id", "start").agg(F.count("*").alias("n"))
    return starts(s, d).join(got, ["graph_id", "start"], "left").select("graph_id", "start", F.coalesce("n", F.lit(0)).alias("answer"))


@query("q13_structure", """, dg AS (SELECT n.graph_id, n.idx, count(*) FILTER (e.src = n.idx) AS o, count(*) FILTER (e.tgt = n.idx) + count(*) FILTER (e.src = n.idx) AS g FROM ents n LEFT JOIN small e ON e.graph_id = n.graph_id GROUP BY ALL)
SELECT graph_id, arg_max(idx, (g, -idx)) AS hub, max(g) AS hub_degree, max(o) AS max_out, coalesce(min(idx) FILTER (g = 0), -1) AS first_isolated FROM dg GROUP BY graph_id""")
def q13_structure(s, d):
    x = graph.degrees(small_edges(s, d), small_entities(s, d)).groupBy("graph_id")
    return x.agg(F.max_by("idx", F.struct(c("degree"), -c("idx"))).alias("hub"), F.max("degree").alias("hub_degree"), F.max("out_degree").alias("max_out"), F.coalesce(F.min(F.when(c("degree") == 0, c("idx"))), F.lit(-1)).alias("first_isolated"))


# ---------------------------------------------------------------- prompt pools

PROPERTY_BANK = ((0, "What is {source} like?"), (1, "What color is {source}?"), (2, "How big is {source}?"), (2, "What size is {source}?"))
SCENES = ("The {adj} {entity} is at the {location}. Describe the scene.", "There is a {adj} {entity} at the {location}.")
MEETINGS = ("{entity1} and {entity2} are at the {location}.", "A {adj1} {entity1} meets a {adj2} {entity2} at the {location}.", "Which is {adj1}, {entity1} or {entity2}?")
DENIALS = ("Can {entity} {action}?", "Is {entity} able to {action}?", "Does {entity} {action}?")
CONTRASTS = ("Is {entity1} bigger than {entity2}?", "Which is older, {entity1} or {entity2}?")
OPEN = ("Tell me about {entity}.", "What is {entity}?", "Describe {entity}.")
PARTS = ", part_n AS (SELECT DISTINCT surface_text FROM nodes)"


def listed(x) -> str:
    return "[" + ", ".join("'" + t + "'" for t in x) + "]"


def pick(x, key: str, salt: str) -> str:
    return f"{listed(x)}[CAST(({hexed(key, salt)}) % {len(x)} AS INTEGER) + 1]"


def hexed(key: str, salt: str) -> str:
    digit = lambda i: f"(strpos('0123456789abcdef', substr(md5('{SEED}:{salt}:' || {key}), {i}, 1)) - 1)"
    return " + ".join(f"{16 ** (3 - i)} * {digit(i + 1)}" for i in range(4))


def property_pairs(s: SparkSession, d: str) -> DataFrame:
    """entity, property, category: the category is that of the property's node modulo 3."""
    n = nodes(s, d).select("id", "surface_text")
    e = edges(s, d, (4,)).filter("NOT negated").join(n.select(c("id").alias("source_id"), c("surface_text").alias("entity")), "source_id")
    e = e.join(n.select(c("id").alias("target_id"), c("surface_text").alias("property")), "target_id")
    return e.select("entity", "property", (c("target_id") % 3).cast("int").alias("category"))


PAIRS = ", pp AS (SELECT a.surface_text AS entity, b.surface_text AS property, CAST(b.id % 3 AS INTEGER) AS category FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.relation_type_id = 4 AND NOT e.negated), lc AS (SELECT a.surface_text AS entity, b.surface_text AS location FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.relation_type_id = 6)"


@query("m2_property_prompts", PAIRS + ", bk(category, template) AS (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in PROPERTY_BANK) + ") SELECT DISTINCT replace(template, '{source}', entity) AS prompt FROM pp JOIN bk USING (category)")
def m2_property_prompts(s, d):
    return prompts.property_prompts(property_pairs(s, d), s.createDataFrame(list(PROPERTY_BANK), "category int, template string"))


def locations(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d).select("id", "surface_text")
    e = edges(s, d, (6,)).join(n.select(c("id").alias("source_id"), c("surface_text").alias("entity")), "source_id")
    return e.join(n.select(c("id").alias("target_id"), c("surface_text").alias("location")), "target_id").select("entity", "location")


ONE_EACH = PAIRS + f""", ep AS (SELECT entity, arg_min(property, (md5('{SEED}:property:' || entity || ':' || property), property)) AS adj FROM pp GROUP BY entity), el AS (SELECT entity, arg_min(location, (md5('{SEED}:location:' || entity || ':' || location), location)) AS location FROM lc GROUP BY entity),
fb AS (SELECT location, row_number() OVER (ORDER BY location) - 1 AS n FROM (SELECT DISTINCT location FROM lc ORDER BY location LIMIT 10)), fc AS (SELECT count(*) AS n FROM fb)
"""


@query("m3_scene_prompts", ONE_EACH + f"""SELECT DISTINCT replace(replace(replace({pick(SCENES, "entity", "scene")}, '{{adj}}', adj), '{{entity}}', entity), '{{location}}', coalesce(el.location, fb.location)) AS prompt FROM ep LEFT JOIN el USING (entity), fc JOIN fb ON true WHERE fb.n = ({hexed("entity", "place")}) % fc.n""")
def m3_scene_prompts(s, d):
    return prompts.scene_prompts(property_pairs(s, d), locations(s, d), SCENES, SEED)


@query("m3_meeting_prompts", ONE_EACH + f""", met AS (SELECT entity, adj, location, row_number() OVER (ORDER BY md5('{SEED}:pair:' || entity), entity) - 1 AS n FROM ep JOIN el USING (entity)), nb AS (SELECT count(*) AS n FROM met)
SELECT DISTINCT replace(replace(replace(replace(replace({pick(MEETINGS, "a.entity || ':' || b.entity", "meeting")}, '{{adj1}}', a.adj), '{{adj2}}', b.adj), '{{entity1}}', a.entity), '{{entity2}}', b.entity), '{{location}}', a.location) AS prompt FROM met a, nb JOIN met b ON true WHERE b.n = (a.n + 1) % nb.n AND a.n <> b.n""")
def m3_meeting_prompts(s, d):
    return prompts.meeting_prompts(property_pairs(s, d), locations(s, d), MEETINGS, SEED)


@query("m4_denial_prompts", f""", subj AS (SELECT DISTINCT source_id AS subject FROM edges WHERE relation_type_id = 5), obj AS (SELECT target_id AS object, row_number() OVER (ORDER BY target_id) - 1 AS n FROM (SELECT DISTINCT target_id FROM edges WHERE relation_type_id = 5)),
p AS (SELECT subject, (((subject + i * 7919) % 2147483648) * 2654435761 + {SEED} * 40503) % 4294967296 % (SELECT count(*) FROM obj) AS n FROM subj, range(0, 2) AS g(i)),
ms AS (SELECT DISTINCT subject, object FROM p JOIN obj USING (n) WHERE (subject, object) NOT IN (SELECT (source_id, target_id) FROM edges WHERE relation_type_id = 5))
SELECT DISTINCT replace(replace({pick(DENIALS, "a.surface_text || ':' || b.surface_text", "denial")}, '{{entity}}', a.surface_text), '{{action}}', b.surface_text) AS prompt FROM ms JOIN nodes a ON a.id = subject JOIN nodes b ON b.id = object""")
def m4_denial_prompts(s, d):
    e, n = edges(s, d, (5,)), nodes(s, d).select("id", "surface_text")
    return prompts.denial_prompts(e, n, "action", DENIALS, 2, SEED)


@query("m5_comparison_prompts", f""", o AS (SELECT surface_text, domain, category, id, row_number() OVER (ORDER BY domain, category, md5('{SEED}:compare:' || id), id) AS n FROM nodes WHERE domain IN (1, 2))
SELECT DISTINCT replace(replace({pick(CONTRASTS, "a.surface_text || ':' || b.surface_text", "contrast")}, '{{entity1}}', a.surface_text), '{{entity2}}', b.surface_text) AS prompt FROM o a JOIN o b ON b.n = a.n + 1 AND a.domain = b.domain AND a.category = b.category""")
def m5_comparison_prompts(s, d):
    return prompts.comparison_prompts(nodes(s, d).filter("domain IN (1, 2)"), CONTRASTS, SEED)


@query("m6_entity_prompts", f"""SELECT DISTINCT replace({pick(OPEN, "surface_text", "open")}, '{{entity}}', surface_text) AS prompt FROM (SELECT DISTINCT surface_text FROM nodes)""")
def m6_entity_prompts(s, d):
    return prompts.entity_prompts(nodes(s, d).select(c("surface_text").alias("entity")), OPEN, SEED)


POOLS = ("m2_property_prompts", "m3_scene_prompts", "m4_denial_prompts", "m5_comparison_prompts", "m6_entity_prompts")


def pools_sql() -> str:
    from lattica.plans.queries import ORACLE_SQL

    found = " UNION ALL ".join(f"SELECT '{k}' AS pool, prompt FROM ({ORACLE_SQL[k]}) AS {k}" for k in POOLS)
    return f"SELECT pool, count(*) AS n, count(DISTINCT lower(prompt)) AS n_unique FROM ({found}) AS found GROUP BY pool"


@query("t3_prompt_pools", pools_sql(), views=False)
def t3_prompt_pools(s, d):
    """The pools in one table."""
    made = {k: globals()[k](s, d) for k in POOLS}
    return prompts.pooled(made).groupBy("pool").agg(F.count("*").alias("n"), F.countDistinct(F.lower("prompt")).alias("n_unique"))
