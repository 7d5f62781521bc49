"""Concept clusters as seeds of generated records: grounding (A), invented (B), two-hop (C) and negated (D).

A cluster is a row: category, cluster (its key), seed_id, concepts (ids in order, few), relations
(source_id, target_id, relation_type_id, weight, negated; in order) and note.  edges have source_id, target_id, relation_type_id,
weight and are true; concepts have id, anchor_token, domain, category, subcategory, specificity.
Seeded orders go by the MD5 of seed and key, so any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import codec
from lattica.operators import kg
from lattica.shared import cut, numbered, parts, spread

#: Edges of this weight or more are strong.
STRONG = 0.3
CAPABLE, PROPERTY, ANTONYM = 5, 4, 22
RELATION = "struct<source_id: bigint, target_id: bigint, relation_type_id: int, weight: double, negated: boolean>"
# Invented names.
INVENTED = (
    "glimthor", "vexnor", "draplix", "quorlam", "zynthar", "brevmok",
    "clispor", "draveen", "elquix", "fenthar", "grolvex", "haxmire",
    "ixpolar", "jentrik", "kolvane", "loxprim", "morquex", "nelvrix",
    "opziran", "prelvox", "quindra", "rexvolt", "silvane", "trixmon",
    "ulvexar", "vornith", "wexplar", "xilvorn", "yentrix", "zolvane",
    "axbrenn", "brixtel", "carvlex", "dexmorn", "elvaxir", "foxvern",
    "gelvrix", "horvane", "ixquell", "joxvire", "krixtel", "loxvane",
    "melvrix", "noxplar", "orvixen", "praxvel", "quelvix", "roxvane",
    "stelvox", "trovixe",
)


def seeded(key: Column, seed: int) -> Column:
    """The place of a key in a seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def _edge(source: Column, target: Column, kind: Column, weight: Column, negated: bool = False) -> Column:
    return F.struct(source.alias("source_id"), target.alias("target_id"), kind.cast("int").alias("relation_type_id"), weight.alias("weight"), F.lit(negated).alias("negated"))


def _key(kind: str, *ids: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *(i.cast("string") for i in ids))


def _first(clusters: DataFrame, count: int | None, seed: int) -> DataFrame:
    """count clusters in the seeded order; count is what the caller asks for.  They are written, as what follows reads them several times."""
    return clusters if count is None else cut(clusters.orderBy(seeded(F.col("cluster"), seed), "cluster").limit(count))


def inner_edges(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, own: the best edge of each source, target and type between two concepts of the cluster, by those.

    Pairs of a cluster's few concepts meet edges by both ends, so hubs don't multiply rows.
    """
    pairs = clusters.select("cluster", F.explode("concepts").alias("source_id"), "concepts").select("cluster", "source_id", F.explode("concepts").alias("target_id"))
    found = pairs.join(edges, ["source_id", "target_id"]).groupBy("cluster", "source_id", "target_id", "relation_type_id").agg(F.max("weight").alias("weight"))
    one = F.struct("source_id", "target_id", "relation_type_id", "weight", F.lit(False).alias("negated"))
    return found.groupBy("cluster").agg(F.array_sort(F.collect_list(one)).cast(f"array<{RELATION}>").alias("own"))


def grounding(rich: DataFrame, edges: DataFrame, count: int | None, seed: int = 42) -> DataFrame:
    """Category A: a rich concept (rich.id) and one of the three best targets of each of one to three relation types."""
    own = edges.join(rich.select(F.col("id").alias("source_id")), "source_id", "left_semi").filter("target_id <> source_id")
    c = kg.type_combinations(own, STRONG).select("seed", "targets")
    c = c.select(F.lit("A").alias("category"), F.concat(_key("A", F.col("seed")), F.lit(":"), F.array_join(F.transform("targets", lambda x: x.cast("string")), ",")).alias("cluster"), F.col("seed").alias("seed_id"), F.concat(F.array("seed"), "targets").alias("concepts"))
    c = _first(c, count, seed)
    return c.join(inner_edges(c, edges), "cluster").select("category", "cluster", "seed_id", "concepts", F.col("own").alias("relations"), F.lit("").alias("note"))


def invented(rich: DataFrame, edges: DataFrame, count: int, seed: int = 42, words: tuple[str, ...] = INVENTED) -> DataFrame:
    """Category B: an invented concept (id -1, -2, ...) with two or three rich ones, and relations that it borrows from the first.

    Rich concepts are taken in a seeded order, seven further for each cluster; note is the invented anchor.  Without
    two rich concepts there are none.
    """
    order = numbered(rich.select("id"), seeded(F.col("id").cast("string"), seed), F.col("id"))
    n = order.count()
    spark = rich.sparkSession
    i = spark.range(count if n >= 2 else 0).select(F.col("id").alias("i"))
    reals = F.least(F.lit(n), 2 + F.conv(F.substring(seeded(F.col("i").cast("string"), seed), 1, 1), 16, 10).cast("int") % 2)
    picks = i.withColumn("n_real", reals).select("i", F.explode(F.sequence(F.lit(0), F.col("n_real") - 1)).alias("j"))
    picks = picks.withColumn("n", (F.col("i") * 7 + F.col("j")) % F.lit(max(n, 1))).join(order, "n")
    c = picks.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "id"))), lambda x: x["id"]).alias("real"))
    donors = c.select(F.get("real", F.lit(0)).alias("source_id")).distinct()
    lent = kg.ranked(edges.join(donors, "source_id", "left_semi"), ["source_id", "relation_type_id"], [F.desc("weight"), F.asc("target_id")], 1)
    lent = kg.ranked(lent, ["source_id"], [F.desc("weight"), F.asc("relation_type_id")], 3, "k")
    lent = lent.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("k", "relation_type_id", "weight"))).alias("lent"))
    c = c.join(lent, F.get("real", F.lit(0)) == F.col("source_id"), "left")
    me = -(F.col("i") + 1)
    anchor = F.concat(F.element_at(F.array(*(F.lit(w) for w in words)), (F.col("i") % len(words) + 1).cast("int")), F.lit("_"), (F.col("i") + 99001).cast("string"))
    borrowed = F.transform(F.slice(F.coalesce("lent", F.array().cast("array<struct<k: int, relation_type_id: int, weight: double>>")), 1, F.size("real")), lambda x: _edge(me, F.get(F.col("real"), x["k"] - 1), x["relation_type_id"], F.round(F.least(x["weight"] * 0.8, F.lit(0.95)), 2)))
    c = c.select(F.lit("B").alias("category"), _key("B", F.col("i")).alias("cluster"), me.alias("seed_id"), F.concat(F.array(me), "real").alias("concepts"), borrowed.cast(f"array<{RELATION}>").alias("borrowed"), anchor.alias("note"))
    c = c.join(inner_edges(c, edges), "cluster", "left")
    c = c.withColumn("relations", F.concat("borrowed", F.coalesce("own", F.array().cast(f"array<{RELATION}>"))))
    return c.filter(F.size("relations") > 0).select("category", "cluster", "seed_id", "concepts", "relations", "note")


def two_hop(chains: DataFrame, count: int | None, seed: int = 42) -> DataFrame:
    """Category C: each distinct a, b, c of chains(a, b, c, t1, t2, w1, w2) once, with two of its relations."""
    types = F.concat_ws(":", F.col("t1").cast("string"), F.col("t2").cast("string"))
    best = F.min_by(F.struct("t1", "t2", "w1", "w2"), F.struct(seeded(types, seed), "t1", "t2", -F.col("w1"), -F.col("w2"))).alias("e")
    c = chains.groupBy("a", "b", "c").agg(best).withColumn("cluster", _key("C", F.col("a"), F.col("b"), F.col("c")))
    c = _first(c, count, seed)
    relations = F.array(_edge(F.col("a"), F.col("b"), F.col("e.t1"), F.col("e.w1")), _edge(F.col("b"), F.col("c"), F.col("e.t2"), F.col("e.w2")))
    return c.select(F.lit("C").alias("category"), "cluster", F.col("a").alias("seed_id"), F.array("a", "b", "c").alias("concepts"), relations.cast(f"array<{RELATION}>").alias("relations"), F.lit("").alias("note"))


def denied(rich: DataFrame, edges: DataFrame, kind: int, count: int | None, seed: int = 42) -> DataFrame:
    """Category D: a rich concept, an edge of the kind as untrue, and one of its two best strong edges of other kinds.

    kind is CAPABLE (D1) or PROPERTY (D3).
    """
    # only edges of sources that have one of the kind are ranked, in parts by the size of edges
    n = parts(edges)
    have = rich.select(F.col("id").alias("source_id")).distinct()
    untrue = spread(edges.filter(F.col("relation_type_id") == kind), "source_id", "target_id", n=n).groupBy("source_id", "target_id").agg(F.max("weight").alias("weight")).join(have, "source_id", "left_semi")
    true = spread(edges.filter((F.col("relation_type_id") != kind) & (F.col("weight") >= STRONG)), "source_id", n=n)
    true = true.join(edges.filter(F.col("relation_type_id") == kind).select("source_id").distinct(), "source_id", "left_semi").join(have, "source_id", "left_semi")
    true = kg.ranked(true, ["source_id"], [F.desc("weight"), F.asc("relation_type_id"), F.asc("target_id")], 2)
    true = true.groupBy("source_id", F.col("target_id").alias("true_id")).agg(F.min_by(F.struct("relation_type_id", "weight"), "rank").alias("t"))
    name = "D1" if kind == CAPABLE else "D3"
    c = untrue.join(true, "source_id").withColumn("cluster", _key(name, F.col("source_id"), F.col("target_id"), F.col("true_id")))
    c = _first(c, count, seed)
    relations = F.array(_edge(F.col("source_id"), F.col("target_id"), F.lit(kind), F.col("weight"), True), _edge(F.col("source_id"), F.col("true_id"), F.col("t.relation_type_id"), F.col("t.weight")))
    return c.select(F.lit("D").alias("category"), "cluster", F.col("source_id").alias("seed_id"), F.array("source_id", "target_id", "true_id").alias("concepts"), relations.cast(f"array<{RELATION}>").alias("relations"), F.lit(f"{name}:{kind}").alias("note"))


def opposites(edges: DataFrame, count: int | None, seed: int = 42, kind: int = ANTONYM) -> DataFrame:
    """Category D2: the two ends of an antonym edge, with the source's best strong edge of another kind."""
    pairs = edges.filter(F.col("relation_type_id") == kind)
    more = kg.ranked(edges.filter((F.col("relation_type_id") != kind) & (F.col("weight") >= STRONG)).join(pairs.select("source_id"), "source_id", "left_semi"), ["source_id"], [F.desc("weight"), F.asc("relation_type_id"), F.asc("target_id")], 1)
    more = more.select("source_id", _edge(F.col("source_id"), F.col("target_id"), F.col("relation_type_id"), F.col("weight")).alias("more"))
    c = pairs.groupBy("source_id", "target_id").agg(F.max("weight").alias("weight")).withColumn("cluster", _key("D2", F.col("source_id"), F.col("target_id")))
    c = _first(c, count, seed).join(more, "source_id", "left")
    third = F.when(F.col("more").isNotNull() & (F.col("more.target_id") != F.col("target_id")), F.array("more.target_id")).otherwise(F.array().cast("array<bigint>"))
    relations = F.array_compact(F.array(_edge(F.col("source_id"), F.col("target_id"), F.lit(kind), F.col("weight")).cast(RELATION), F.col("more").cast(RELATION)))
    return c.select(F.lit("D").alias("category"), "cluster", F.col("source_id").alias("seed_id"), F.concat(F.array("source_id", "target_id"), third).alias("concepts"), relations.alias("relations"), F.lit(f"D2:{kind}").alias("note"))


def thirds(count: int) -> tuple[int, int, int]:
    """How many clusters D1, D2 and D3 are asked for."""
    each = max(1, count // 3)
    rest = count - 3 * each
    return each + (rest > 0), each + (rest > 1), each


def category_counts(total: int, shares: dict[str, int]) -> dict[str, int]:
    """total split in proportion to shares; the last category takes what rounding down leaves."""
    whole, names = sum(shares.values()), list(shares)
    out = {k: total * shares[k] // whole for k in names[:-1]}
    return out | {names[-1]: total - sum(out.values())}


def select_clusters(rich: DataFrame, edges: DataFrame, chains: DataFrame, counts: dict[str, int], seed: int = 42, antonym: int = ANTONYM) -> DataFrame:
    """Clusters of all categories asked for, with place (from 0) in a seeded order."""
    parts = []
    if counts.get("A", 0) > 0:
        parts.append(grounding(rich, edges, counts["A"], seed))
    if counts.get("B", 0) > 0:
        parts.append(invented(rich, edges, counts["B"], seed))
    if counts.get("C", 0) > 0:
        parts.append(two_hop(chains, counts["C"], seed))
    if counts.get("D", 0) > 0:
        one, two, three = thirds(counts["D"])
        d = denied(rich, edges, CAPABLE, one, seed).unionByName(opposites(edges, two, seed, antonym)).unionByName(denied(rich, edges, PROPERTY, three, seed))
        parts.append(d.orderBy("note", "cluster").limit(counts["D"]) if one + two + three > counts["D"] else d)
    if not parts:
        raise ValueError("no category is asked for")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return numbered(out, seeded(F.col("cluster"), seed), F.col("cluster")).withColumnRenamed("n", "place")


def invented_concepts(clusters: DataFrame) -> DataFrame:
    """Concept rows of the invented seeds."""
    zero = [F.lit(0).alias(c) for c in ("domain", "category", "subcategory", "specificity")]
    return clusters.filter("seed_id < 0").select(F.col("seed_id").alias("id"), F.split("note", "_")[0].alias("surface_text"), F.col("note").alias("anchor_token"), *zero)


def best_modifiers(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """source_id, modifier: the anchor of the heaviest property."""
    top = kg.ranked(edges.filter(F.col("relation_type_id") == PROPERTY), ["source_id"], [F.desc("weight"), F.asc("target_id")], 1)
    return top.join(concepts.select(F.col("id").alias("target_id"), F.col("anchor_token").alias("modifier")), "target_id").select("source_id", "modifier")


def cluster_blocks(clusters: DataFrame, concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, block: entities with their best modifier and confidence, then relations.

    A concept's confidence is the heaviest relation at it, to two digits, 0.5 at least, 0.85 without one.  Of relations of one
    type between the same two, whatever their sign, the heaviest stays, at the place of the first.  A concept listed twice is
    referred to by its last place.
    """
    known = concepts.select("id", "domain", "category", "subcategory", "specificity", "anchor_token").unionByName(invented_concepts(clusters).drop("surface_text"))
    m = clusters.select("cluster", F.posexplode("concepts").alias("pos", "id"), "relations")
    heaviest = F.array_max(F.transform(F.filter("relations", lambda r: (r["source_id"] == F.col("id")) | (r["target_id"] == F.col("id"))), lambda r: r["weight"]))
    m = m.select("cluster", "pos", "id", F.coalesce(F.greatest(F.round(heaviest, 2), F.lit(0.5)), F.lit(0.85)).alias("confidence"))
    m = m.join(known, "id").join(best_modifiers(edges, concepts).withColumnRenamed("source_id", "id"), "id", "left")
    line = codec.format_eda(*(F.col(x) for x in ("domain", "category", "subcategory", "specificity", "anchor_token")), F.coalesce("modifier", F.lit("0")), F.lit(0), F.col("confidence"))
    entities = m.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("entities"))
    place = lambda x: F.when(F.array_contains("concepts", x), F.size("concepts") - F.array_position(F.reverse("concepts"), x)).cast("int")
    r = clusters.select("cluster", "concepts", F.posexplode("relations").alias("seq", "r")).select("cluster", "seq", "r.relation_type_id", place(F.col("r.source_id")).alias("src"), place(F.col("r.target_id")).alias("tgt"), F.col("r.weight").alias("weight"), F.col("r.negated").alias("negated")).filter("src >= 0 AND tgt >= 0")
    r = r.groupBy("cluster", "relation_type_id", "src", "tgt").agg(F.min("seq").alias("seq"), F.max_by(F.struct("weight", "negated"), F.struct(F.col("weight"), -F.col("seq"))).alias("e"))
    line = codec.format_ra(F.col("relation_type_id"), F.col("src"), F.col("tgt"), F.col("e.weight"), F.lit(0), F.col("e.negated"))
    relations = r.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return entities.join(relations, "cluster", "left").select("cluster", codec.format_block(F.col("entities"), F.coalesce("lines", F.array().cast("array<string>"))).alias("block"))


def facts(clusters: DataFrame, concepts: DataFrame) -> DataFrame:
    """cluster, facts, truth: what a cluster's relations say, as bullet lines and as a sentence; names not known are '?'."""
    names = concepts.select("id", "surface_text").unionByName(invented_concepts(clusters).select("id", "surface_text"))
    r = clusters.select("cluster", F.posexplode("relations").alias("seq", "r")).select("cluster", "seq", "r.*")
    for side in ("source", "target"):
        r = r.join(names.select(F.col("id").alias(f"{side}_id"), F.col("surface_text").alias(side)), f"{side}_id", "left")
    label = kg.relation_types(clusters.sparkSession).select(F.col("id").alias("relation_type_id"), "label")
    r = r.join(F.broadcast(label), "relation_type_id", "left")
    said = F.concat(F.when(F.col("negated"), F.lit("NOT_")).otherwise(F.lit("")), F.coalesce("label", F.col("relation_type_id").cast("string")))
    one = F.concat_ws(" ", F.coalesce("source", F.lit("?")), said, F.coalesce("target", F.lit("?")))
    g = r.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("line")))), lambda x: x["line"]).alias("l"))
    return g.select("cluster", F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x)), "\n").alias("facts"), F.concat(F.array_join("l", "; "), F.lit(".")).alias("truth"))
