"""Registered queries of concept clusters: selection by category, blocks and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import clusters, kg
from lattica.plans.queries import query
from lattica.shared import cut
from lattica.sources.tables import concepts, edges, nodes

#: Clusters asked for; the derived graph has no antonyms, so edges of PartOf stand for them.
COUNTS, OPPOSITE, SEED = {"A": 400, "B": 160, "C": 160, "D": 80}, 2, 42
c = F.col


def true_edges(s: SparkSession, d: str) -> DataFrame:
    """The derived graph's true edges, written once: a query reads them many times."""
    return cut(edges(s, d).filter("NOT negated").select("source_id", "target_id", "relation_type_id", F.round("weight", 2).alias("weight")))


def rich(s: SparkSession, d: str, e: DataFrame) -> DataFrame:
    """Rich concepts, written once: every category reads them."""
    return cut(kg.rich_concepts(nodes(s, d), e))


BASE = r""", te AS (SELECT source_id, target_id, relation_type_id, round(weight, 2) AS weight FROM edges WHERE NOT negated),
con AS (SELECT id, surface_text, domain, category, regexp_replace(replace(replace(lower(surface_text), ' ', '_'), '-', '_'), '[^\p{L}\p{N}_]', '', 'g') || '_' || id AS anchor FROM nodes),
rich AS (SELECT source_id AS id FROM te GROUP BY source_id HAVING count(*) >= 3 AND count(DISTINCT relation_type_id) >= 2 AND sum(CASE WHEN weight >= 0.5 THEN 1 ELSE 0 END) >= 1),
md AS (SELECT source_id, con.anchor AS modifier FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS r FROM te WHERE relation_type_id = 4) JOIN con ON con.id = target_id WHERE r = 1),
own AS (SELECT te.* FROM te JOIN rich ON rich.id = source_id)
"""
INNER = """, pr AS (SELECT cluster, s, unnest(concepts) AS t FROM (SELECT cluster, concepts, unnest(concepts) AS s FROM cl)),
inr AS (SELECT cluster, s, t, relation_type_id AS k, max(weight) AS w FROM (SELECT DISTINCT * FROM pr) JOIN te ON source_id = s AND target_id = t GROUP BY ALL)
"""
BLOCKS = """, mem AS (SELECT cluster, unnest(range(0, len(concepts))) AS pos, unnest(concepts) AS id FROM cl), last AS (SELECT cluster, id, max(pos) AS pos FROM mem GROUP BY ALL),
cf AS (SELECT mem.cluster, pos, mem.id, coalesce(greatest(round(max(w), 2), 0.5), 0.85) AS conf FROM mem LEFT JOIN rel ON rel.cluster = mem.cluster AND (rel.s = mem.id OR rel.t = mem.id) GROUP BY ALL),
el AS (SELECT cluster, string_agg('E(' || domain || '|' || category || '|0|0|' || anchor || '|' || coalesce(modifier, '0') || '|0|' || CAST(CAST(conf AS DOUBLE) AS VARCHAR) || ')', chr(10) ORDER BY pos) AS e FROM cf JOIN con ON con.id = cf.id LEFT JOIN md ON md.source_id = cf.id GROUP BY cluster),
rd AS (SELECT rel.cluster, k, a.pos AS sp, b.pos AS tp, min(seq) AS seq, arg_max(neg, (w, -seq)) AS neg, max(w) AS w FROM rel JOIN last a ON a.cluster = rel.cluster AND a.id = rel.s JOIN last b ON b.cluster = rel.cluster AND b.id = rel.t GROUP BY rel.cluster, k, a.pos, b.pos),
rl AS (SELECT cluster, string_agg('R(' || CASE WHEN neg THEN 'NOT_' ELSE '' END || label || '|' || sp || '|' || tp || '|' || CAST(w AS VARCHAR) || '|0|0)', chr(10) ORDER BY seq) AS r FROM rd JOIN rt ON rt.id = k GROUP BY cluster)
SELECT el.cluster, '<sml>' || chr(10) || e || coalesce(chr(10) || r, '') || chr(10) || '</sml>' AS block FROM el LEFT JOIN rl ON rl.cluster = el.cluster
"""


def first_sql(n: int) -> str:
    return f"ORDER BY md5('{SEED}:' || cluster), cluster LIMIT {n}"


A_SQL = f"""{BASE}, top AS (SELECT * FROM (SELECT source_id AS seed, relation_type_id AS k, target_id AS x, row_number() OVER (PARTITION BY source_id, relation_type_id ORDER BY weight DESC, target_id) AS r FROM own WHERE weight >= 0.3 AND source_id <> target_id) WHERE r <= 3),
lst AS (SELECT seed, [x] AS xs FROM top UNION ALL SELECT a.seed, [a.x, b.x] FROM top a JOIN top b ON a.seed = b.seed AND a.k < b.k UNION ALL SELECT a.seed, [a.x, b.x, e.x] FROM top a JOIN top b ON a.seed = b.seed AND a.k < b.k JOIN top e ON e.seed = a.seed AND b.k < e.k),
srt AS (SELECT DISTINCT seed, list_sort(list_distinct(xs)) AS xs FROM lst),
cl AS (SELECT 'A:' || seed || ':' || array_to_string(xs, ',') AS cluster, list_concat([seed], xs) AS concepts FROM srt {first_sql(COUNTS["A"])})
{INNER}, rel AS (SELECT *, false AS neg, row_number() OVER (PARTITION BY cluster ORDER BY s, t, k) - 1 AS seq FROM inr) {BLOCKS}"""


def blocks(s: SparkSession, d: str, found: DataFrame, e: DataFrame) -> DataFrame:
    return clusters.cluster_blocks(cut(found), concepts(s, d), e).select("cluster", "block")


@query("c6_grounding_clusters", A_SQL)
def c6_grounding_clusters(s, d):
    e = true_edges(s, d)
    return blocks(s, d, clusters.grounding(rich(s, d, e), e, COUNTS["A"], SEED), e)


WORDS = "[" + ", ".join(f"'{w}'" for w in clusters.INVENTED) + "]"
B_SQL = f"""{BASE.replace("con AS (", "con0 AS (").replace("con.", "con0.").replace("JOIN con ON", "JOIN con0 ON")}, ord AS (SELECT id, row_number() OVER (ORDER BY md5('{SEED}:' || id), id) - 1 AS n FROM rich), cnt AS (SELECT count(*) AS n FROM rich),
nr AS (SELECT i, least(cnt.n, 2 + (strpos('0123456789abcdef', md5('{SEED}:' || i)[1]) - 1) % 2) AS nr, cnt.n AS n FROM range(0, {COUNTS["B"]}) AS g(i), cnt WHERE cnt.n >= 2),
pk AS (SELECT i, j, ord.id FROM (SELECT i, n, unnest(range(0, nr)) AS j FROM nr) q JOIN ord ON ord.n = (q.i * 7 + j) % q.n),
b AS (SELECT i, list(id ORDER BY j) AS reals FROM pk GROUP BY i),
con AS (SELECT * FROM con0 UNION ALL SELECT -(i + 1), '', 0, 0, {WORDS}[i % {len(clusters.INVENTED)} + 1] || '_' || (i + 99001) FROM b),
lent AS (SELECT source_id, k, w, row_number() OVER (PARTITION BY source_id ORDER BY w DESC, k) AS n FROM (SELECT source_id, relation_type_id AS k, max(weight) AS w FROM te GROUP BY ALL)),
cl AS (SELECT 'B:' || i AS cluster, list_concat([-(i + 1)], reals) AS concepts FROM b)
{INNER}, rel AS (SELECT 'B:' || i AS cluster, -(i + 1) AS s, reals[n] AS t, k, round(least(w * 0.8, CAST(0.95 AS DOUBLE)), 2) AS w, false AS neg, n - 1 AS seq FROM b JOIN lent ON source_id = reals[1] AND n <= least(3, len(reals))
UNION ALL SELECT cluster, s, t, k, w, false, 2 + row_number() OVER (PARTITION BY cluster ORDER BY s, t, k) FROM inr) {BLOCKS}"""


@query("c7_invented_clusters", B_SQL)
def c7_invented_clusters(s, d):
    e = true_edges(s, d)
    return blocks(s, d, clusters.invented(rich(s, d, e), e, COUNTS["B"], SEED), e)


C_SQL = f"""{BASE}, ch AS (SELECT a.source_id AS a, a.target_id AS b, e.target_id AS c, a.relation_type_id AS t1, e.relation_type_id AS t2, a.weight AS w1, e.weight AS w2
FROM te a JOIN te e ON a.target_id = e.source_id WHERE a.weight >= 0.3 AND e.weight >= 0.3 AND a.source_id <> e.target_id AND a.source_id <> a.target_id AND a.relation_type_id <> e.relation_type_id
ORDER BY a.weight + e.weight DESC, a, b, c, t1, t2, a.weight LIMIT 100000),
one AS (SELECT a, b, c, arg_min({{'t1': t1, 't2': t2, 'w1': w1, 'w2': w2}}, (md5('{SEED}:' || t1 || ':' || t2), t1, t2, -w1, -w2)) AS e FROM ch GROUP BY ALL),
pick AS (SELECT 'C:' || a || ':' || b || ':' || c AS cluster, * FROM one {first_sql(COUNTS["C"])}), cl AS (SELECT cluster, [a, b, c] AS concepts FROM pick),
rel AS (SELECT cluster, a AS s, b AS t, e.t1 AS k, e.w1 AS w, false AS neg, 0 AS seq FROM pick UNION ALL SELECT cluster, b, c, e.t2, e.w2, false, 1 FROM pick) {BLOCKS}"""


@query("c8_two_hop_clusters", C_SQL)
def c8_two_hop_clusters(s, d):
    e = true_edges(s, d)
    return blocks(s, d, clusters.two_hop(kg.two_hop_chains(e), COUNTS["C"], SEED), e)


def _denied_sql(name: str, kind: int, n: int) -> str:
    return f"""{BASE}, tr AS (SELECT source_id, target_id AS true_id, arg_min(relation_type_id, r) AS tk, arg_min(weight, r) AS tw FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, relation_type_id, target_id) AS r FROM own WHERE relation_type_id <> {kind} AND weight >= 0.3) WHERE r <= 2 GROUP BY ALL),
un AS (SELECT source_id, target_id, max(weight) AS w FROM own WHERE relation_type_id = {kind} GROUP BY ALL),
pick AS (SELECT '{name}:' || source_id || ':' || target_id || ':' || true_id AS cluster, * FROM un JOIN tr USING (source_id) {first_sql(n)}), cl AS (SELECT cluster, [source_id, target_id, true_id] AS concepts FROM pick),
rel AS (SELECT cluster, source_id AS s, target_id AS t, {kind} AS k, w, true AS neg, 0 AS seq FROM pick UNION ALL SELECT cluster, source_id, true_id, tk, tw, false, 1 FROM pick) {BLOCKS}"""


ONE, TWO, THREE = clusters.thirds(COUNTS["D"])


@query("c9_denied_abilities", _denied_sql("D1", 5, ONE))
def c9_denied_abilities(s, d):
    e = true_edges(s, d)
    return blocks(s, d, clusters.denied(rich(s, d, e), e, clusters.CAPABLE, ONE, SEED), e)


@query("c9_denied_properties", _denied_sql("D3", 4, THREE))
def c9_denied_properties(s, d):
    e = true_edges(s, d)
    return blocks(s, d, clusters.denied(rich(s, d, e), e, clusters.PROPERTY, THREE, SEED), e)


D2_SQL = f"""{BASE}, mr AS (SELECT * FROM (SELECT source_id, target_id AS mt, relation_type_id AS mk, weight AS mw, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, relation_type_id, target_id) AS r FROM te WHERE relation_type_id <> {OPPOSITE} AND weight >= 0.3) WHERE r = 1),
pick AS (SELECT 'D2:' || p.source_id || ':' || target_id AS cluster, p.*, mt, mk, mw FROM (SELECT source_id, target_id, max(weight) AS w FROM te WHERE relation_type_id = {OPPOSITE} GROUP BY ALL) p LEFT JOIN mr ON mr.source_id = p.source_id {first_sql(TWO)}),
cl AS (SELECT cluster, list_concat([source_id, target_id], CASE WHEN mt <> target_id THEN [mt] ELSE [] END) AS concepts FROM pick),
rel AS (SELECT cluster, source_id AS s, target_id AS t, {OPPOSITE} AS k, w, false AS neg, 0 AS seq FROM pick UNION ALL SELECT cluster, source_id, mt, mk, mw, false, 1 FROM pick WHERE mt IS NOT NULL) {BLOCKS}"""


@query("c9_opposites", D2_SQL)
def c9_opposites(s, d):
    e = true_edges(s, d)
    return blocks(s, d, clusters.opposites(e, TWO, SEED, OPPOSITE), e)


def selected(s: SparkSession, d: str, e: DataFrame) -> DataFrame:
    return clusters.select_clusters(rich(s, d, e), e, kg.two_hop_chains(e), COUNTS, SEED, OPPOSITE)


def union_sql() -> str:
    """The clusters of all categories: each block query as a table of its own, without its blocks."""
    parts = (("A", A_SQL), ("B", B_SQL), ("C", C_SQL), ("D", _denied_sql("D1", 5, ONE)), ("D", D2_SQL), ("D", _denied_sql("D3", 4, THREE)))
    found = " UNION ALL ".join(f"SELECT '{k}' AS category, cluster FROM (WITH {sql.strip().lstrip(',')}) AS t{i}" for i, (k, sql) in enumerate(parts))
    return f"SELECT category, cluster, row_number() OVER (ORDER BY md5('{SEED}:' || cluster), cluster) - 1 AS place FROM ({found}) AS found"


@query("c10_selected_clusters", union_sql())
def c10_selected_clusters(s, d):
    """All categories in one seeded order."""
    return selected(s, d, true_edges(s, d)).select("category", "cluster", "place")


@query("c11_selected_blocks", " UNION ALL ".join(f"SELECT * FROM (WITH {x.strip().lstrip(',')}) AS t{i}" for i, x in enumerate((A_SQL, B_SQL, C_SQL, _denied_sql("D1", 5, ONE), D2_SQL, _denied_sql("D3", 4, THREE)))))
def c11_selected_blocks(s, d):
    e = true_edges(s, d)
    return blocks(s, d, selected(s, d, e), e)


@query("f14_cluster_facts", C_SQL.replace(BLOCKS, f""", ft AS (SELECT cluster, seq, coalesce(a.surface_text, '?') || ' ' || CASE WHEN neg THEN 'NOT_' ELSE '' END || label || ' ' || coalesce(b.surface_text, '?') AS line FROM rel JOIN rt ON rt.id = k LEFT JOIN con a ON a.id = s LEFT JOIN con b ON b.id = t)
SELECT cluster, string_agg('- ' || line, chr(10) ORDER BY seq) AS facts, string_agg(line, '; ' ORDER BY seq) || '.' AS truth FROM ft GROUP BY cluster"""))
def f14_cluster_facts(s, d):
    """Ids to names, F14: facts and truth of a cluster."""
    return clusters.facts(clusters.two_hop(kg.two_hop_chains(true_edges(s, d)), COUNTS["C"], SEED), concepts(s, d))
