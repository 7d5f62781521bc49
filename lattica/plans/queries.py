"""The registered queries of the graph engine, with DuckDB SQL for the same rows.

Names begin with the id of the operator that they run.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import codec, text
from lattica.operators import graph, kg, records, search
from lattica.schemas import RELATION_TYPES
from lattica.shared import spread
from lattica.sources.tables import SMALL_TYPES, VIEWS_SQL, edges, nodes, small_edges, small_entities, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col
RT_SQL = "rt(id, label, inverse_label) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in RELATION_TYPES) + "),"


def query(name: str, sql: str | None = None, views: bool = True):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {RT_SQL}{VIEWS_SQL}{sql}" if views else sql
        return f

    return keep


# ---------------------------------------------------------------- lookups, adjacency, rankings over the large graph

A1_SQL = """SELECT id, surface_text, count(DISTINCT relation_type_id) AS type_count, count(*) AS total_rels, CAST(sum(CASE WHEN weight >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS strong_rels
FROM nodes JOIN edges ON source_id = id GROUP BY id, surface_text HAVING count(*) >= 3 AND count(DISTINCT relation_type_id) >= 2 AND sum(CASE WHEN weight >= 0.5 THEN 1 ELSE 0 END) >= 1"""


@query("a1_rich_concepts", A1_SQL)
def a1_rich_concepts(s, d):
    return kg.rich_concepts(nodes(s, d), edges(s, d)).select("id", "surface_text", "type_count", "total_rels", "strong_rels")


@query("s5_all_concepts", "SELECT id, surface_text, domain, category FROM nodes")
def s5_all_concepts(s, d):
    return nodes(s, d)


@query("s5_all_relations", "SELECT source_id, target_id, relation_type_id, round(weight, 6) AS weight, negated FROM edges")
def s5_all_relations(s, d):
    return edges(s, d).withColumn("weight", F.round("weight", 6))


@query("a2_counts", "SELECT (SELECT count(*) FROM nodes) AS n_concepts, (SELECT count(*) FROM edges) AS n_relations")
def a2_counts(s, d):
    one = nodes(s, d).agg(F.count("*").alias("n_concepts")).withColumn("k", F.lit(1))
    return one.join(edges(s, d).agg(F.count("*").alias("n_relations")).withColumn("k", F.lit(1)), "k").drop("k")


@query("p1_lookup_concept", "SELECT upper(c_name) AS text, min(id) AS id FROM customer JOIN nodes ON lower(surface_text) = lower(c_name) GROUP BY upper(c_name)")
def p1_lookup_concept(s, d):
    return kg.lookup_concepts(nodes(s, d), table(s, d, "customer").select(F.upper("c_name").alias("text")).distinct()).select("text", "id")


@query("p3_relation_types", "SELECT id, label, inverse_label FROM rt")
def p3_relation_types(s, d):
    return kg.relation_types(s)


@query("p5_get_relations", "SELECT n.id AS concept_id, e.source_id, e.target_id, e.relation_type_id FROM edges e JOIN nodes n ON (e.source_id = n.id OR e.target_id = n.id)")
def p5_get_relations(s, d):
    return kg.adjacent(edges(s, d), nodes(s, d).select(c("id").alias("concept_id"))).select("concept_id", "source_id", "target_id", "relation_type_id")


@query("p7_strong_edges", "SELECT relation_type_id, count(*) AS n FROM edges WHERE weight >= 0.5 GROUP BY ALL")
def p7_strong_edges(s, d):
    return edges(s, d).filter("weight >= 0.5").groupBy("relation_type_id").agg(F.count("*").alias("n"))


@query("j1_labelled_edges", "SELECT label, inverse_label, count(*) AS n FROM edges JOIN rt ON rt.id = relation_type_id GROUP BY ALL")
def j1_labelled_edges(s, d):
    return kg.labelled(edges(s, d)).groupBy("label", "inverse_label").agg(F.count("*").alias("n"))


@query("j2_outgoing_relations", "SELECT e.source_id, e.target_id, rt.label, n.surface_text AS target_text FROM edges e JOIN rt ON rt.id = e.relation_type_id JOIN nodes n ON n.id = e.target_id")
def j2_outgoing_relations(s, d):
    return kg.outgoing(edges(s, d), nodes(s, d)).select("source_id", "target_id", "label", c("target_surface_text").alias("target_text"))


@query("j3_adjacency_lists", "SELECT source_id, string_agg(CAST(target_id AS VARCHAR), ',' ORDER BY weight DESC, target_id, relation_type_id, negated) AS targets FROM edges GROUP BY source_id")
def j3_adjacency_lists(s, d):
    e = edges(s, d).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct((-c("weight")).alias("w"), "target_id", "relation_type_id", "negated"))).alias("l"))
    return e.select("source_id", F.array_join(F.transform("l", lambda x: x["target_id"].cast("string")), ",").alias("targets"))


@query("j4_pairs_of_type", "SELECT a.surface_text AS source_text, b.surface_text AS target_text, round(e.weight, 6) AS weight FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.relation_type_id = 5 AND e.negated")
def j4_pairs_of_type(s, d):
    n = nodes(s, d)
    e = edges(s, d, (5,)).filter("negated")
    e = e.join(n.select(c("id").alias("source_id"), c("surface_text").alias("source_text")), "source_id").join(n.select(c("id").alias("target_id"), c("surface_text").alias("target_text")), "target_id")
    return e.select("source_text", "target_text", F.round("weight", 6).alias("weight"))


@query("j5_relation_texts", "SELECT e.relation_type_id, a.surface_text AS source_text, b.surface_text AS target_text FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id")
def j5_relation_texts(s, d):
    n = nodes(s, d)
    e = edges(s, d).join(n.select(c("id").alias("source_id"), c("surface_text").alias("source_text")), "source_id")
    return e.join(n.select(c("id").alias("target_id"), c("surface_text").alias("target_text")), "target_id").select("relation_type_id", "source_text", "target_text")


@query("j6_two_hop_chains", """SELECT a.source_id AS a, a.target_id AS b, e.target_id AS c, a.relation_type_id AS t1, e.relation_type_id AS t2, round(a.weight, 6) AS w1, round(e.weight, 6) AS w2
FROM edges a JOIN edges e ON a.target_id = e.source_id WHERE a.weight >= 0.3 AND e.weight >= 0.3 AND a.source_id <> e.target_id AND a.source_id <> a.target_id AND a.relation_type_id <> e.relation_type_id
ORDER BY a.weight + e.weight DESC, a, b, c, t1, t2, a.weight LIMIT 100000""")
def j6_two_hop_chains(s, d):
    return kg.two_hop_chains(edges(s, d)).withColumns({"w1": F.round("w1", 6), "w2": F.round("w2", 6)})


MEMBERS_SQL = "members AS (SELECT source_id AS cluster_id, unnest([source_id, target_id]) AS concept_id FROM edges WHERE relation_type_id IN (1, 4) UNION SELECT target_id, source_id FROM edges WHERE relation_type_id = 2),"


def members(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d, (1, 4)).select(c("source_id").alias("cluster_id"), F.explode(F.array("source_id", "target_id")).alias("concept_id"))
    return e.unionByName(edges(s, d, (2,)).select(c("target_id").alias("cluster_id"), c("source_id").alias("concept_id"))).distinct()


INDUCED_SQL = MEMBERS_SQL.rstrip(",") + """, ind AS (SELECT s.cluster_id, e.source_id, e.target_id, e.relation_type_id, max(e.weight) AS weight FROM edges e JOIN members s ON s.concept_id = e.source_id JOIN members t ON t.concept_id = e.target_id AND t.cluster_id = s.cluster_id GROUP BY ALL)"""


@query("j8_induced_subgraphs", f", {INDUCED_SQL} SELECT cluster_id, source_id, target_id, relation_type_id, round(weight, 6) AS weight FROM ind")
def j8_induced_subgraphs(s, d):
    return kg.induced(edges(s, d), members(s, d)).withColumn("weight", F.round("weight", 6))


@query("a4_entity_confidence", f""", {INDUCED_SQL} SELECT m.cluster_id, m.concept_id, coalesce(greatest(round(max(i.weight), 2), 0.5), 0.85) AS confidence FROM members m
LEFT JOIN ind i ON i.cluster_id = m.cluster_id AND (i.source_id = m.concept_id OR i.target_id = m.concept_id) GROUP BY ALL""")
def a4_entity_confidence(s, d):
    m = members(s, d)
    return kg.entity_confidence(m, kg.induced(edges(s, d), m))


@query("a3_best_edge_of_source", "SELECT source_id, arg_max(target_id, (weight, -target_id, -relation_type_id)) AS target_id, round(max(weight), 6) AS weight FROM edges GROUP BY source_id")
def a3_best_edge_of_source(s, d):
    return kg.best_edges(edges(s, d), "source_id").select("source_id", "target_id", F.round("weight", 6).alias("weight"))


@query("j10_capable_entities", "SELECT id, surface_text FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE relation_type_id = 5)")
def j10_capable_entities(s, d):
    return nodes(s, d).join(edges(s, d, (5,)).select(c("source_id").alias("id")), "id", "left_semi").select("id", "surface_text")


@query("j11_missing_pairs", """, subj AS (SELECT DISTINCT source_id AS subject FROM edges WHERE relation_type_id = 5), obj AS (SELECT target_id AS object, row_number() OVER (ORDER BY target_id) - 1 AS n FROM (SELECT DISTINCT target_id FROM edges WHERE relation_type_id = 4)),
p AS (SELECT subject, (((subject + i * 7919) % 2147483648) * 2654435761 + 3 * 40503) % 4294967296 % (SELECT count(*) FROM obj) AS n FROM subj, range(0, 3) AS g(i))
SELECT DISTINCT subject, object FROM p JOIN obj USING (n) WHERE (subject, object) NOT IN (SELECT (source_id, target_id) FROM edges WHERE relation_type_id IN (4, 5))""")
def j11_missing_pairs(s, d):
    subjects = edges(s, d, (5,)).select(c("source_id").alias("subject")).distinct()
    objects = edges(s, d, (4,)).select(c("target_id").alias("object"))
    return kg.missing_pairs(subjects, objects, edges(s, d, (4, 5)), 3, 3)


@query("j12_same_group_pairs", "SELECT id, domain, category, count(*) OVER (PARTITION BY domain, category) - 1 AS n_partners FROM nodes")
def j12_same_group_pairs(s, d):
    return kg.same_group(nodes(s, d), "domain", "category").select("id", "domain", "category", "n_partners")


@query("j13_type_combinations", """, top AS (SELECT * FROM (SELECT source_id AS seed, relation_type_id AS t, target_id AS x, row_number() OVER (PARTITION BY source_id, relation_type_id ORDER BY weight DESC, target_id) AS r FROM edges WHERE weight >= 0.3 AND NOT negated) WHERE r <= 3),
l AS (SELECT seed, [x] AS xs FROM top UNION ALL SELECT a.seed, [a.x, b.x] FROM top a JOIN top b ON a.seed = b.seed AND a.t < b.t UNION ALL SELECT a.seed, [a.x, b.x, e.x] FROM top a JOIN top b ON a.seed = b.seed AND a.t < b.t JOIN top e ON e.seed = a.seed AND b.t < e.t)
SELECT DISTINCT seed, array_to_string(list_sort(list_distinct(xs)), ',') AS targets FROM l""")
def j13_type_combinations(s, d):
    e = edges(s, d).filter("NOT negated")
    return kg.type_combinations(e).select("seed", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query("w1_top_targets_by_type", "SELECT source_id, relation_type_id, target_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id, relation_type_id ORDER BY weight DESC, target_id) AS r FROM edges WHERE NOT negated) WHERE r <= 3")
def w1_top_targets_by_type(s, d):
    return kg.ranked(edges(s, d).filter("NOT negated"), ["source_id", "relation_type_id"], [F.desc("weight"), F.asc("target_id")], 3).select("source_id", "relation_type_id", "target_id", "rank")


@query("w2_best_modifier", "SELECT source_id, target_id AS modifier FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS r FROM edges WHERE relation_type_id = 4) WHERE r = 1")
def w2_best_modifier(s, d):
    return kg.ranked(edges(s, d, (4,)), ["source_id"], [F.desc("weight"), F.asc("target_id")], 1).select("source_id", c("target_id").alias("modifier"))


@query("w3_two_modifiers", """SELECT source_id, target_id, CAST(r AS INTEGER) AS rank FROM (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN n.domain = 4 THEN 0 ELSE 1 END, weight DESC, target_id) AS r
FROM edges e JOIN nodes n ON n.id = e.target_id WHERE relation_type_id IN (1, 4) AND NOT negated) WHERE r <= 2""")
def w3_two_modifiers(s, d):
    e = edges(s, d, (1, 4)).filter("NOT negated").join(nodes(s, d).select(c("id").alias("target_id"), "domain"), "target_id")
    return kg.ranked(e, ["source_id"], [F.when(c("domain") == 4, 0).otherwise(1), F.desc("weight"), F.asc("target_id")], 2).select("source_id", "target_id", "rank")


@query("w8_one_edge_of_each_type", """SELECT source_id, relation_type_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, relation_type_id, target_id) AS r2 FROM
(SELECT *, row_number() OVER (PARTITION BY source_id, relation_type_id ORDER BY weight DESC, target_id) AS r FROM edges WHERE NOT negated) WHERE r = 1) WHERE r2 <= 3""")
def w8_one_edge_of_each_type(s, d):
    one = kg.ranked(edges(s, d).filter("NOT negated"), ["source_id", "relation_type_id"], [F.desc("weight"), F.asc("target_id")], 1)
    return kg.ranked(one, ["source_id"], [F.desc("weight"), F.asc("relation_type_id"), F.asc("target_id")], 3, "r2").select("source_id", "relation_type_id", "target_id")


@query("w9_first_true_relation", "SELECT source_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, relation_type_id, target_id) AS r FROM edges WHERE relation_type_id <> 22 AND weight >= 0.3 AND NOT negated) WHERE r = 1")
def w9_first_true_relation(s, d):
    e = edges(s, d).filter("relation_type_id <> 22 AND weight >= 0.3 AND NOT negated")
    return kg.ranked(e, ["source_id"], [F.desc("weight"), F.asc("relation_type_id"), F.asc("target_id")], 1).select("source_id", "target_id")


@query("w10_true_for_negated", """, t AS (SELECT source_id, target_id AS true_id, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS r FROM edges WHERE relation_type_id = 5 AND NOT negated)
SELECT e.source_id, e.target_id AS negated_id, t.true_id FROM edges e JOIN t ON t.source_id = e.source_id AND t.r <= 2 WHERE e.negated""")
def w10_true_for_negated(s, d):
    e = edges(s, d, (5,))
    top = kg.ranked(e.filter("NOT negated"), ["source_id"], [F.desc("weight"), F.asc("target_id")], 2).select("source_id", c("target_id").alias("true_id"))
    return e.filter("negated").join(top, "source_id").select("source_id", c("target_id").alias("negated_id"), "true_id")


@query("w4_first_ordinals", """, p AS (SELECT c_custkey AS rn, c_name AS source, c_mktsegment AS target FROM customer),
f AS (SELECT word, min(pl) AS pl FROM (SELECT source AS word, rn * 2 AS pl FROM p UNION ALL SELECT target, rn * 2 + 1 FROM p) GROUP BY word)
SELECT word AS text, CAST(r AS INTEGER) AS ordinal FROM (SELECT word, row_number() OVER (ORDER BY pl) AS r FROM f)""")
def w4_first_ordinals(s, d):
    return kg.first_ordinals(table(s, d, "customer").select(c("c_custkey").alias("row"), c("c_name").alias("source"), c("c_mktsegment").alias("target")))


@query("p15_budgeted_admission", """, q AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'rich' WHEN c_custkey % 3 = 1 THEN 'thin' ELSE 'unknown' END AS quality FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY k) AS nth FROM q)
SELECT k, quality FROM r WHERE quality = 'rich' OR (quality = 'thin' AND nth <= greatest(5, CAST(floor((SELECT count(*) FROM q) * 0.2) AS BIGINT))) OR (quality = 'unknown' AND nth <= greatest(1, CAST(floor((SELECT count(*) FROM q) * 0.05) AS BIGINT)))""")
def p15_budgeted_admission(s, d):
    q = table(s, d, "customer").select(c("c_custkey").alias("k"), F.when(c("c_custkey") % 3 == 0, "rich").when(c("c_custkey") % 3 == 1, "thin").otherwise("unknown").alias("quality"))
    return kg.admitted(q, "quality", "k", q.count()).select("k", "quality")


@query("a5_degrees", "SELECT id, count(s) AS degree FROM nodes LEFT JOIN (SELECT source_id AS i, 1 AS s FROM edges UNION ALL SELECT target_id, 1 FROM edges) ON i = id GROUP BY id")
def a5_degrees(s, d):
    e = edges(s, d)
    ends = e.select(c("source_id").alias("id")).unionAll(e.select("target_id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes(s, d).select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


@query("a7_hubs", "SELECT id, degree FROM (SELECT id, count(s) AS degree FROM nodes LEFT JOIN (SELECT source_id AS i, 1 AS s FROM edges UNION ALL SELECT target_id, 1 FROM edges) ON i = id GROUP BY id) ORDER BY degree DESC, id LIMIT 50")
def a7_hubs(s, d):
    return a5_degrees(s, d).orderBy(F.desc("degree"), "id").limit(50)


@query("t1_isolated", "SELECT k AS relation_type_id, n.id FROM nodes n, (SELECT unnest([1, 2, 4, 5, 6, 18]) AS k) WHERE (n.id, k) NOT IN (SELECT (source_id, relation_type_id) FROM edges UNION SELECT (target_id, relation_type_id) FROM edges)")
def t1_isolated(s, d):
    e = edges(s, d)
    touched = e.select("relation_type_id", c("source_id").alias("id")).union(e.select("relation_type_id", "target_id"))
    every = F.explode(F.array(*(F.lit(k) for k in (1, 2, 4, 5, 6, 18)))).alias("relation_type_id")
    return nodes(s, d).select("id", every).join(touched, ["relation_type_id", "id"], "left_anti")


@query("t6_append_new_pairs", "SELECT DISTINCT source_id, target_id FROM edges")
def t6_append_new_pairs(s, d):
    """Old pairs and new ones are grouped together once, so each is kept once wherever it comes from."""
    return spread(edges(s, d).select("source_id", "target_id"), "source_id", "target_id").distinct()


X1_SQL = r""", w AS (SELECT id, list_filter(regexp_split_to_array(lower(surface_text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM nodes),
p AS (SELECT token, id, len(w) AS length, count(*) AS tf FROM (SELECT id, w, unnest(w) AS token FROM w) GROUP BY ALL),
sz AS (SELECT count(*) AS n, avg(length) AS al FROM (SELECT DISTINCT id, length FROM p)),
h AS (SELECT id, length, t, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT *, 0 AS t FROM p WHERE token = 'customer' UNION ALL SELECT *, 1 FROM p WHERE starts_with(token, '00000001')) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM h GROUP BY t),
sc AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) AS score FROM h JOIN df USING (t), sz GROUP BY id HAVING count(*) = 2)
SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM sc ORDER BY rank LIMIT 20"""


@query("x1_search_concepts", X1_SQL)
def x1_search_concepts(s, d):
    return search.search(search.postings(nodes(s, d), "surface_text"), "customer 00000001", 20).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- many small graphs


def starts(s: SparkSession, d: str) -> DataFrame:
    return small_entities(s, d).select("graph_id", c("idx").alias("start"))


CLOSURE = """, e AS (SELECT DISTINCT graph_id, src, tgt FROM small WHERE {where}),
cl(graph_id, start, node) AS (SELECT graph_id, idx, idx FROM ents UNION SELECT cl.graph_id, cl.start, e.tgt FROM cl JOIN e ON e.graph_id = cl.graph_id AND e.src = cl.node)
"""


@query("g5_reachable", CLOSURE.format(where="true") + "SELECT * FROM cl WHERE node <> start")
def g5_reachable(s, d):
    return graph.reachable(small_edges(s, d), starts(s, d))


@query("g5_reachable_typed", CLOSURE.format(where="rel_type IN ('IsA', 'HasPrerequisite')") + "SELECT * FROM cl WHERE node <> start")
def g5_reachable_typed(s, d):
    return graph.reachable(small_edges(s, d), starts(s, d), ["IsA", "HasPrerequisite"])


@query("g6_threshold_reachable", CLOSURE.format(where="weight >= 0.75") + "SELECT * FROM cl WHERE node <> start")
def g6_threshold_reachable(s, d):
    return graph.reachable(small_edges(s, d), starts(s, d), None, 0.75)


@query("g7_chain_endpoint", """, f AS (SELECT graph_id, rel_type, src, arg_min(tgt, seq) AS tgt FROM small GROUP BY ALL)
SELECT n.graph_id, n.idx AS start, coalesce(b.tgt, -1) AS endpoint FROM ents n LEFT JOIN f a ON a.graph_id = n.graph_id AND a.src = n.idx AND a.rel_type = 'IsA' LEFT JOIN f b ON b.graph_id = n.graph_id AND b.src = a.tgt AND b.rel_type = 'CapableOf'""")
def g7_chain_endpoint(s, d):
    return graph.chain_endpoint(small_edges(s, d), starts(s, d), ["IsA", "CapableOf"]).withColumn("endpoint", F.coalesce("endpoint", F.lit(-1)))


PATHS = """, h AS (SELECT graph_id, src, tgt, seq, first_value(weight) OVER (PARTITION BY graph_id, src, tgt ORDER BY seq) AS hop FROM small),
pt(graph_id, path, node, low, prod, ok) AS (SELECT graph_id, [idx], idx, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST([] AS BIGINT[]) FROM ents WHERE idx = 0
UNION ALL SELECT pt.graph_id, list_append(path, h.tgt), h.tgt, coalesce(least(low, hop), hop), prod * hop, list_append(ok, h.seq) FROM pt JOIN h ON h.graph_id = pt.graph_id AND h.src = pt.node WHERE NOT list_contains(path, h.tgt) AND pt.node <> 4 AND len(path) <= 10),
ap AS (SELECT graph_id, array_to_string(path, '>') AS path, coalesce(low, 0) AS low, prod, ok FROM pt WHERE node = 4)
"""


def ends(s: SparkSession, d: str) -> DataFrame:
    return graph.all_paths(small_edges(s, d), table(s, d, "orders").select(c("o_orderkey").cast("long").alias("graph_id"), F.lit(0).cast("long").alias("start"), F.lit(4).cast("long").alias("end")))


def joined(path):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


@query("g8_all_paths", PATHS + "SELECT graph_id, path, round(low, 6) AS bottleneck, round(prod, 10) AS product FROM ap")
def g8_all_paths(s, d):
    return ends(s, d).select("graph_id", joined("path").alias("path"), F.round("bottleneck", 6).alias("bottleneck"), F.round("product", 10).alias("product"))


@query("g9_strongest_path", PATHS + "SELECT graph_id, path, round(low, 6) AS bottleneck FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY low DESC, ok) AS r FROM ap) WHERE r = 1")
def g9_strongest_path(s, d):
    return graph.strongest_path(ends(s, d)).select("graph_id", joined("path").alias("path"), F.round("bottleneck", 6).alias("bottleneck"))


@query("g10_strongest_product_path", PATHS + "SELECT graph_id, path, round(prod, 10) AS product FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY round(prod, 10) DESC, ok) AS r FROM ap) WHERE r = 1")
def g10_strongest_product_path(s, d):
    p = ends(s, d).withColumn("product", F.round("product", 10))
    return graph.strongest_path(p, "product").select("graph_id", joined("path").alias("path"), F.round("product", 10).alias("product"))


@query("g11_path_weights", """, h AS (SELECT graph_id, src, tgt, arg_min(weight, seq) AS w FROM small GROUP BY ALL), st AS (SELECT o_orderkey AS graph_id, a.i AS src, a.i + 1 AS tgt FROM orders, range(0, 4) AS a(i))
SELECT st.graph_id AS path_id, round(coalesce(min(w), 0), 6) AS bottleneck, round(coalesce(product(w), 1), 10) AS product FROM st LEFT JOIN h ON h.graph_id = st.graph_id AND h.src = st.src AND h.tgt = st.tgt GROUP BY st.graph_id""")
def g11_path_weights(s, d):
    p = table(s, d, "orders").select(c("o_orderkey").cast("long").alias("graph_id"), c("o_orderkey").alias("path_id"), F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>").alias("path"))
    return graph.path_weights(small_edges(s, d), p).select("path_id", F.round("bottleneck", 6).alias("bottleneck"), F.round("product", 10).alias("product"))


@query("g12_effective_properties", CLOSURE.format(where="rel_type = 'IsA'") + """SELECT DISTINCT cl.graph_id, cl.start, 'X' || p.tgt AS property FROM cl JOIN small p ON p.graph_id = cl.graph_id AND p.src = cl.node AND p.rel_type = 'HasProperty'
WHERE NOT EXISTS (SELECT 1 FROM small n WHERE n.graph_id = cl.graph_id AND n.src = cl.start AND n.tgt = p.tgt AND n.rel_type = 'NOT_HasProperty')""")
def g12_effective_properties(s, d):
    return graph.effective_properties(small_edges(s, d), starts(s, d))


@query("g13_prerequisites", CLOSURE.format(where="rel_type = 'HasPrerequisite'") + """, b AS (SELECT DISTINCT cl.graph_id, cl.start, cl.node FROM cl JOIN small n ON n.graph_id = cl.graph_id AND n.src = cl.start AND n.tgt = cl.node AND n.rel_type = 'NOT_CapableOf' WHERE cl.node <> cl.start)
SELECT n.graph_id, n.idx AS start, count(b.node) = 0 AS satisfiable, coalesce(string_agg(CAST(b.node AS VARCHAR), ',' ORDER BY b.node), '') AS blockers FROM ents n LEFT JOIN b ON b.graph_id = n.graph_id AND b.start = n.idx GROUP BY ALL""")
def g13_prerequisites(s, d):
    return graph.prerequisites(small_edges(s, d), starts(s, d)).withColumn("blockers", F.array_join(F.transform("blockers", lambda x: x.cast("string")), ","))


SIGNED = """, sg AS (SELECT graph_id, src, tgt, replace(rel_type, 'NOT_', '') AS base, sum(CASE WHEN rel_type LIKE 'NOT_%' THEN 0 ELSE 1 END) AS p, sum(CASE WHEN rel_type LIKE 'NOT_%' THEN 1 ELSE 0 END) AS n,
max(CASE WHEN rel_type NOT LIKE 'NOT_%' THEN weight END) AS pw, max(CASE WHEN rel_type LIKE 'NOT_%' THEN weight END) AS nw FROM small GROUP BY ALL)
"""


@query("g14_contradictions", SIGNED + "SELECT graph_id, src, tgt, base, CAST(p AS BIGINT) AS n_positive, CAST(n AS BIGINT) AS n_negative, CASE WHEN pw >= nw THEN 'positive' ELSE 'negative' END AS resolved FROM sg WHERE p > 0 AND n > 0")
def g14_contradictions(s, d):
    return graph.contradictions(small_edges(s, d))


@query("g15_degrees", """SELECT n.graph_id, n.idx, count(*) FILTER (e.tgt = n.idx) AS in_degree, count(*) FILTER (e.src = n.idx) AS out_degree, count(*) FILTER (e.tgt = n.idx) + count(*) FILTER (e.src = n.idx) AS degree
FROM ents n LEFT JOIN small e ON e.graph_id = n.graph_id GROUP BY ALL""")
def g15_degrees(s, d):
    return graph.degrees(small_edges(s, d), small_entities(s, d))


@query("g15_hubs", """SELECT graph_id, idx, degree FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, idx) AS r FROM (SELECT n.graph_id, n.idx, count(*) FILTER (e.tgt = n.idx) + count(*) FILTER (e.src = n.idx) AS degree
FROM ents n LEFT JOIN small e ON e.graph_id = n.graph_id GROUP BY ALL)) WHERE r = 1""")
def g15_hubs(s, d):
    return graph.hubs(g15_degrees(s, d)).select("graph_id", "idx", "degree")


@query("g15_isolated", "SELECT graph_id, idx FROM ents n WHERE NOT EXISTS (SELECT 1 FROM small e WHERE e.graph_id = n.graph_id AND (e.src = n.idx OR e.tgt = n.idx))")
def g15_isolated(s, d):
    return graph.isolated(small_edges(s, d), small_entities(s, d))


BLOCKS = """, el AS (SELECT graph_id, string_agg('E(0|0|0|0|X' || idx || '|0|0|0.9)', chr(10) ORDER BY idx) AS e FROM ents GROUP BY graph_id),
rl AS (SELECT graph_id, string_agg('R(' || rel_type || '|' || src || '|' || tgt || '|' || printf('%.2f', weight) || '|0|0)', chr(10) ORDER BY seq) AS r, count(*) AS n_relations, count(DISTINCT rel_type) AS n_types, count(*) FILTER (src = 0) AS n_out FROM small GROUP BY graph_id),
bl AS (SELECT el.graph_id, '<sml>' || chr(10) || e || coalesce(chr(10) || r, '') || chr(10) || '</sml>' AS block, coalesce(n_relations, 0) AS n_relations, coalesce(n_types, 0) AS n_types, coalesce(n_out, 0) AS n_out FROM el LEFT JOIN rl USING (graph_id))
"""


def blocks(s: SparkSession, d: str) -> DataFrame:
    return graph.to_blocks(small_edges(s, d), small_entities(s, d))


@query("g17_blocks", BLOCKS + "SELECT graph_id, block FROM bl")
def g17_blocks(s, d):
    return blocks(s, d)


@query("a16_block_counts", BLOCKS + "SELECT graph_id, 5 AS n_entities, CAST(n_relations AS INTEGER) AS n_relations, CAST(n_types AS INTEGER) AS n_types, CAST(n_out AS INTEGER) AS n_out FROM bl")
def a16_block_counts(s, d):
    b = blocks(s, d).select("graph_id", codec.parse_entities(c("block")).alias("e"), codec.parse_relations(c("block")).alias("r"))
    label = lambda x: F.concat(x["negated"].cast("string"), x["label"])
    return b.select("graph_id", F.size("e").alias("n_entities"), F.size("r").alias("n_relations"), F.size(F.array_distinct(F.transform("r", label))).alias("n_types"), F.size(F.filter("r", lambda x: F.get(x["slots"], F.lit(1)) == "0")).alias("n_out"))


@query("f4_parse_relations", "SELECT graph_id, seq, replace(rel_type, 'NOT_', '') AS label, rel_type LIKE 'NOT_%' AS negated, src, tgt, round(weight, 2) AS weight FROM small")
def f4_parse_relations(s, d):
    r = blocks(s, d).select("graph_id", F.posexplode(codec.parse_relations(c("block"))).alias("i", "r"))
    slot = lambda i: F.get("r.slots", F.lit(i))
    seq = small_edges(s, d).select("graph_id", "seq", (F.row_number().over(Window.partitionBy("graph_id").orderBy("seq")) - 1).alias("i"))
    return r.join(seq, ["graph_id", "i"]).select("graph_id", "seq", c("r.label").alias("label"), c("r.negated").alias("negated"), slot(1).cast("long").alias("src"), slot(2).cast("long").alias("tgt"), slot(3).cast("double").alias("weight"))


@query("f5_strict_relations", "SELECT graph_id, count(*) AS n, round(sum(weight), 4) AS weight FROM small GROUP BY graph_id")
def f5_strict_relations(s, d):
    r = blocks(s, d).select("graph_id", F.explode(codec.strict_relations(c("block"))).alias("r"))
    return r.groupBy("graph_id").agg(F.count("*").alias("n"), F.round(F.sum("r.weight"), 4).alias("weight"))


WORDS_SQL = "CASE rel_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codec.RELATION_WORDS.items()) + " ELSE lower(replace(rel_type, '_', ' ')) END"


@query("f6_in_words", f""", wl AS (SELECT graph_id, string_agg('- X' || src || ' ' || {WORDS_SQL} || ' X' || tgt || ' (confidence: ' || CAST(weight AS VARCHAR) || ')', chr(10) ORDER BY seq) AS w FROM small GROUP BY graph_id)
SELECT n.graph_id, 'The following entities and relationships are defined:' || chr(10) || 'Entities: X0, X1, X2, X3, X4' || chr(10) || coalesce('Relationships:' || chr(10) || w, 'No relationships are defined.') AS words
FROM (SELECT DISTINCT graph_id FROM ents) n LEFT JOIN wl USING (graph_id)""")
def f6_in_words(s, d):
    return blocks(s, d).select("graph_id", codec.in_words(c("block")).alias("words"))


@query("p13_block_quality", "SELECT n.graph_id, CASE WHEN count(e.seq) > 0 THEN 'rich' ELSE 'thin' END AS quality FROM (SELECT DISTINCT graph_id FROM ents) n LEFT JOIN small e ON e.graph_id = n.graph_id GROUP BY n.graph_id")
def p13_block_quality(s, d):
    return blocks(s, d).select("graph_id", text.block_quality(c("block")).alias("quality"))


# ---------------------------------------------------------------- questions: answers from the solver


@query("q3_multi_hop")
def q3_multi_hop(s, d):
    return graph.chain_endpoint(small_edges(s, d), starts(s, d), ["HasPrerequisite", "CapableOf"]).withColumn("endpoint", F.coalesce("endpoint", F.lit(-1)))


ORACLE_SQL["q3_multi_hop"] = ORACLE_SQL["g7_chain_endpoint"].replace("a.rel_type = 'IsA'", "a.rel_type = 'HasPrerequisite'")


@query("q1_lookup", "SELECT n.graph_id, n.idx AS src, n.rel_type, coalesce('X' || arg_min(e.tgt, e.seq), 'Not specified') AS answer FROM (SELECT *, unnest(['IsA', 'HasProperty', 'HasPrerequisite', 'CapableOf', 'NOT_CapableOf', 'NOT_HasProperty']) AS rel_type FROM ents) n LEFT JOIN small e ON e.graph_id = n.graph_id AND e.src = n.idx AND e.rel_type = n.rel_type GROUP BY ALL")
def q1_lookup(s, d):
    e = graph.first_edges(small_edges(s, d), "rel_type", "src")
    asked = small_entities(s, d).select("graph_id", c("idx").alias("src"), F.explode(F.array(*(F.lit(t) for t in SMALL_TYPES))).alias("rel_type"))
    return asked.join(e, ["graph_id", "src", "rel_type"], "left").select("graph_id", "src", "rel_type", F.coalesce(F.concat(F.lit("X"), c("tgt").cast("string")), F.lit("Not specified")).alias("answer"))


@query("q2_negation", "SELECT graph_id, src, string_agg('X' || tgt, ',' ORDER BY seq) AS answer FROM small WHERE rel_type LIKE 'NOT_%' GROUP BY ALL")
def q2_negation(s, d):
    e = small_edges(s, d).filter(c("rel_type").startswith("NOT_")).groupBy("graph_id", "src").agg(F.array_sort(F.collect_list(F.struct("seq", "tgt"))).alias("l"))
    return e.select("graph_id", "src", F.array_join(F.transform("l", lambda x: F.concat(F.lit("X"), x["tgt"].cast("string"))), ",").alias("answer"))


@query("q4_weight_comparison", """, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY seq) AS i FROM small)
SELECT a.graph_id, CASE WHEN b.graph_id IS NULL THEN 'incomparable' WHEN a.weight = b.weight THEN 'equal' WHEN a.weight > b.weight THEN 'first' ELSE 'second' END AS answer FROM r a LEFT JOIN r b ON b.graph_id = a.graph_id AND b.i = 2 WHERE a.i = 1""")
def q4_weight_comparison(s, d):
    g = small_edges(s, d).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("seq", "weight"))).alias("l"))
    a, b = F.get("l", F.lit(0))["weight"], F.get("l", F.lit(1))["weight"]
    return g.select("graph_id", F.when(b.isNull(), "incomparable").when(a == b, "equal").when(a > b, "first").otherwise("second").alias("answer"))


@query("q10_closure_size", CLOSURE.format(where="rel_type IN ('IsA', 'HasPrerequisite')") + "SELECT graph_id, start, count(*) AS answer FROM cl WHERE node <> start GROUP BY ALL")
def q10_closure_size(s, d):
    return g5_reachable_typed(s, d).groupBy("graph_id", "start").agg(F.count("*").alias("answer"))


@query("q9_threshold_counts", CLOSURE.format(where="weight >= 0.6") + "SELECT n.graph_id, n.idx AS start, count(cl.node) AS answer FROM ents n LEFT JOIN cl ON cl.graph_id = n.graph_id AND cl.start = n.idx AND cl.node <> cl.start GROUP BY ALL")
def q9_threshold_counts(s, d):
    got = graph.reachable(small_edges(s, d), starts(s, d), None, 0.6).groupBy("graph_id", "start").agg(F.count("*").alias("n"))
    return starts(s, d).join(got, ["graph_id", "start"], "left").select("graph_id", "start", F.coalesce("n", F.lit(0)).alias("answer"))


@query("q8_first_target", "SELECT graph_id, rel_type, src, arg_min(tgt, seq) AS answer FROM small GROUP BY ALL")
def q8_first_target(s, d):
    return graph.first_edges(small_edges(s, d), "rel_type", "src").select("graph_id", "rel_type", "src", c("tgt").alias("answer"))


@query("l11_shuffled_choices", """, m AS (SELECT CAST(c_custkey AS BIGINT) AS k, list_sort([{'h': (((CAST(c_custkey AS BIGINT) * 31 + i * 7919) % 2147483648) * 2654435761 + 5 * 40503) % 4294967296, 'i': i} for i in [0, 1, 2, 3]]) AS m FROM customer)
SELECT k, array_to_string([['north', 'south', 'east', 'west'][x.i + 1] for x in m], ',') AS choices, CAST(list_position([x.i for x in m], 2) - 1 AS INTEGER) AS answer FROM m""")
def l11_shuffled_choices(s, d):
    choices = F.array(*(F.lit(x) for x in ("north", "south", "east", "west")))
    n = table(s, d, "customer").select(c("c_custkey").cast("long").alias("k")).withColumn("x", records.shuffle_choices(choices, F.lit(2), c("k"), 5))
    return n.select("k", F.array_join("x.choices", ",").alias("choices"), c("x.answer").alias("answer"))


# ---------------------------------------------------------------- prompts

TEMPLATES = (("6", "Where is {source}?"), ("6", "Is {source} at {target}?"), ("1", "What kind of thing is {source}?"), ("4", "What is {source} like?"), ("2", "Is {source} part of {target}?"), ("5", "Can {source} supply {target}?"), ("18", "Does {source} want {target}?"))
TEMPLATES_SQL = "tp(kind, template) AS (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in TEMPLATES) + ")"


def prompts(s: SparkSession, d: str) -> DataFrame:
    """Edges' ends become texts one at a time, and equal rows fall together in between: many concepts share a text."""
    n = nodes(s, d).select("id", "surface_text")
    e = spread(edges(s, d), "target_id").join(n.select(c("id").alias("target_id"), c("surface_text").alias("target")), "target_id")
    e = spread(e.select("relation_type_id", "source_id", "target"), "source_id").distinct()
    e = e.join(n.select(c("id").alias("source_id"), c("surface_text").alias("source")), "source_id").select(c("relation_type_id").cast("string").alias("kind"), "source", "target")
    return records.fill_templates(e, s.createDataFrame(list(TEMPLATES), "kind string, template string"))


PROMPTS_SQL = f""", {TEMPLATES_SQL}, pr AS (SELECT DISTINCT kind, a.surface_text AS source, b.surface_text AS target, replace(replace(template, '{{source}}', a.surface_text), '{{target}}', b.surface_text) AS prompt
FROM edges e JOIN tp ON tp.kind = e.relation_type_id JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id)
"""


@query("m1_relation_prompts", PROMPTS_SQL + "SELECT CAST(kind AS VARCHAR) AS kind, source, target, prompt FROM pr")
def m1_relation_prompts(s, d):
    return prompts(s, d)


@query("w5_first_of_duplicates", PROMPTS_SQL + "SELECT lower(prompt) AS prompt, min(source || '|' || target || '|' || kind) AS first FROM pr GROUP BY lower(prompt)")
def w5_first_of_duplicates(s, d):
    p = prompts(s, d).withColumn("first", F.concat_ws("|", "source", "target", "kind"))
    return records.first_of_duplicates(p, "prompt", "first").select(F.lower("prompt").alias("prompt"), "first")


@query("a17_unique_prompts", PROMPTS_SQL + "SELECT CAST(kind AS VARCHAR) AS kind, count(DISTINCT lower(prompt)) AS n FROM pr GROUP BY kind")
def a17_unique_prompts(s, d):
    p = prompts(s, d).select("kind", F.lower("prompt").alias("prompt"))
    return spread(p, "kind", "prompt").groupBy("kind").agg(F.countDistinct("prompt").alias("n"))


SHARES = (("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1))


@query("l7_quota_sample", """WITH sh(category, share) AS (VALUES """ + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in SHARES) + """),
h AS (SELECT category, share, doc_id AS key, ((doc_id % 2147483648) * 2654435761 + 9 * 40503) % 4294967296 AS h FROM documents JOIN sh ON lang = category),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, key) AS r FROM h),
o AS (SELECT *, CASE WHEN r > greatest(1, CAST(floor(share * 100) AS INT)) THEN 1 ELSE 0 END AS over FROM r)
SELECT category, key, CAST(row_number() OVER (ORDER BY over, h, category, key) AS INTEGER) AS nth FROM o ORDER BY nth LIMIT 100""", views=False)
def l7_quota_sample(s, d):
    pool = table(s, d, "documents").select(c("lang").alias("category"), c("doc_id").alias("key"))
    return records.quota_sample(pool, s.createDataFrame(list(SHARES), "category string, share double"), 100, 9)


@query("l9_train_test_split", "SELECT doc_id, CASE WHEN ((doc_id % 2147483648) * 2654435761 + 42 * 40503) % 4294967296 < 429496729 THEN 'test' ELSE 'train' END AS part FROM documents", views=False)
def l9_train_test_split(s, d):
    return records.split(table(s, d, "documents").select("doc_id"), "doc_id")


@query("l5_seeded_shuffle", "SELECT CAST(c_custkey AS BIGINT) AS k, CAST(row_number() OVER (ORDER BY ((CAST(c_custkey AS BIGINT) % 2147483648) * 2654435761 + 7 * 40503) % 4294967296, c_custkey) AS INTEGER) AS place FROM customer", views=False)
def l5_seeded_shuffle(s, d):
    return records.shuffled(table(s, d, "customer").select(c("c_custkey").cast("long").alias("k")), "k", 7)


# ---------------------------------------------------------------- texts and records


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def has_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query("p11_content_words", rf"""SELECT doc_id, CAST(len(list_filter(w, lambda x: NOT list_contains([{quoted(text.STOP_WORDS)}], lower(x)))) AS INTEGER) AS n_content, CAST(len(w) AS INTEGER) AS n_words
FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents)""", views=False)
def p11_content_words(s, d):
    w = table(s, d, "documents").select("doc_id", text.words(c("text")).alias("w"))
    return w.select("doc_id", F.size(F.filter("w", lambda x: ~text.is_stop_word(x))).alias("n_content"), F.size("w").alias("n_words"))


@query("p14_punt_answers", f"SELECT conv_id, turn, {has_sql('lower(text)', text.PUNT_PHRASES)} AS punt FROM conversations", views=False)
def p14_punt_answers(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.is_punt(c("text")).alias("punt"))


P16 = f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'empty question' WHEN length(text) < 10 THEN 'too short (' || length(text) || ' chars)' WHEN length(text) > 300 THEN 'too long (' || length(text) || ' chars)'
WHEN NOT ends_with(trim(text), '?') THEN 'does not end with ?' WHEN regexp_matches(text, '\\b\\w+_\\d{{3,}}\\b') THEN 'contains anchor token' {" ".join(f"WHEN contains(lower(text), '{n.lower()}') THEN 'contains relation name ''{n}'''" for n in text.RELATION_NAMES)} END AS error FROM conversations"""


@query("p16_question_errors", P16, views=False)
def p16_question_errors(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.question_error(c("text")).alias("error"))


P18 = f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 'empty answer' WHEN length(text) < 20 THEN 'too short (' || length(text) || ' chars)' WHEN length(text) > 1000 THEN 'too long (' || length(text) || ' chars)'
WHEN regexp_matches(text, '\\b\\w+_\\d{{3,}}\\b') THEN 'contains anchor token' {" ".join(f"WHEN contains(lower(text), '{n.lower()}') THEN 'contains relation name ''{n}'''" for n in text.RELATION_NAMES)}
{" ".join(f"WHEN contains(lower(text), '{n.lower()}') THEN 'contains jargon ''{n}'''" for n in text.ANSWER_JARGON)} WHEN {has_sql('lower(text)', text.PUNT_PHRASES)} THEN 'punt response' END AS error FROM conversations"""


@query("p18_answer_errors", P18, views=False)
def p18_answer_errors(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.answer_error(c("text")).alias("error"))


@query("x4_asked_category", "SELECT conv_id, turn, CAST(CASE " + " ".join(f"WHEN {has_sql('lower(text)', ws)} THEN {k}" for k, ws in text.QUERY_WORDS) + " ELSE 0 END AS INTEGER) AS category FROM conversations", views=False)
def x4_asked_category(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(text.asked_category(c("text")), F.lit(0)).alias("category"))


@query("x3_property_category", "SELECT id, CAST(CASE " + " ".join(f"WHEN surface_text = '{w}' THEN {k}" for w, k in text.PROPERTY_SEEDS.items()) + " " + " ".join(f"WHEN {has_sql('surface_text', ws)} THEN {k}" for k, ws in text.DEFINITION_HINTS.items()) + " ELSE 0 END AS INTEGER) AS category FROM nodes")
def x3_property_category(s, d):
    return nodes(s, d).select("id", text.property_category(c("surface_text"), c("surface_text")).alias("category"))


@query("p21_scores", """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'stupid') THEN 'FAIL' WHEN contains(lower(text), 'the') THEN 'PASS' WHEN contains(lower(text || ' ' || role), 'user') THEN 'PARTIAL' ELSE 'FAIL' END AS grade FROM conversations""", views=False)
def p21_scores(s, d):
    words = lambda *w: F.array(*(F.lit(x) for x in w))
    t = table(s, d, "conversations")
    return t.select("conv_id", "turn", text.score(c("text"), c("role"), words("the", "user"), words("stupid")).alias("grade"))


@query("a12_grades", """WITH g AS (SELECT role, CASE WHEN contains(lower(text), 'stupid') THEN 'FAIL' WHEN contains(lower(text), 'the') THEN 'PASS' WHEN contains(lower(text || ' ' || role), 'user') THEN 'PARTIAL' ELSE 'FAIL' END AS grade FROM conversations)
SELECT coalesce(role, 'TOTAL') AS role, count(*) FILTER (grade = 'PASS') AS n_pass, count(*) FILTER (grade = 'PARTIAL') AS n_partial, count(*) FILTER (grade = 'FAIL') AS n_fail, round(100.0 * count(*) FILTER (grade = 'PASS') / count(*), 1) AS pass_pct FROM g GROUP BY ROLLUP (role)""", views=False)
def a12_grades(s, d):
    g = p21_scores(s, d).join(table(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    n = lambda x: F.count(F.when(c("grade") == x, 1))
    return records.with_total(g, "role", n("PASS").alias("n_pass"), n("PARTIAL").alias("n_partial"), n("FAIL").alias("n_fail"), F.round(100.0 * n("PASS") / F.count("*"), 1).alias("pass_pct"))


@query("a11_category_counts", "SELECT coalesce(event_type, 'TOTAL') AS event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)", views=False)
def a11_category_counts(s, d):
    return records.with_total(table(s, d, "events"), "event_type", F.count("*").alias("n"))


@query("a13_recall", """, t AS (SELECT r_name AS key, ['EUROPE_X', 'ALGERIA', 'BRAZIL', 'CANADA', 'FRANCE', 'INDIA'] AS expected FROM region), f AS (SELECT r_name AS key, list(n_name) AS got FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT key, array_to_string(list_sort(list_filter(expected, lambda x: NOT list_contains(coalesce(got, []), x))), ',') AS missing, CASE WHEN got IS NULL THEN 'MISSING_CONCEPT' WHEN list_has_all(got, expected) THEN 'PASS' ELSE 'MISSING' END AS status FROM t LEFT JOIN f USING (key)""")
def a13_recall(s, d):
    truth = table(s, d, "region").select(c("r_name").alias("key"), F.array(*(F.lit(x) for x in ("EUROPE_X", "ALGERIA", "BRAZIL", "CANADA", "FRANCE", "INDIA"))).alias("expected"))
    found = table(s, d, "nation").join(table(s, d, "region"), c("n_regionkey") == c("r_regionkey")).select(c("r_name").alias("key"), c("n_name").alias("value"))
    return records.recall(truth, found).select("key", F.array_join("missing", ",").alias("missing"), "status")


@query("a15_worst_documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10", views=False)
def a15_worst_documents(s, d):
    return table(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


@query("t7_distinct_then_expand", "SELECT conv_id, turn, length(lower(text)) AS n FROM conversations", views=False)
def t7_distinct_then_expand(s, d):
    t = table(s, d, "conversations").select("conv_id", "turn", "text")
    done = t.select("text").distinct().withColumn("n", F.length(F.lower("text")).cast("long"))
    return t.join(done, t["text"].eqNullSafe(done["text"])).select("conv_id", "turn", "n")


@query("f12_anchor_tokens", r"SELECT doc_id, regexp_replace(replace(replace(lower(source), ' ', '_'), '-', '_'), '[^\p{L}\p{N}_]', '', 'g') || '_' || doc_id AS anchor FROM documents", views=False)
def f12_anchor_tokens(s, d):
    return table(s, d, "documents").select("doc_id", text.anchor_token(c("source"), c("doc_id")).alias("anchor"))


@query("f23_last_sentences", "SELECT doc_id, array_to_string(p[greatest(1, len(p) - 2):len(p)], '. ') AS tail FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)", views=False)
def f23_last_sentences(s, d):
    return table(s, d, "documents").select("doc_id", text.last_sentences(c("text")).alias("tail"))


@query("f24_tail_snippet", "SELECT doc_id, right(text, 2048) AS tail FROM documents", views=False)
def f24_tail_snippet(s, d):
    return table(s, d, "documents").select("doc_id", F.expr("right(text, 2048)").alias("tail"))


@query("f25_json_fields", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS value FROM events", views=False)
def f25_json_fields(s, d):
    key = F.get(F.json_object_keys("props"), F.lit(0))
    return table(s, d, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), key).alias("value"))


@query("r_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", views=False)
def r_windows(s, d):
    """Extension: hourly counts of events, as the streaming form gives them."""
    return table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(c("w.start").alias("start"), "event_type", "n")
