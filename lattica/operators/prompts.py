"""Prompt pools from a graph's texts and banks of templates.

Banks are hand-written and come from the caller (files, through the JSON-lines reader).  Each choice is by the MD5 of seed,
purpose and key, so it is the same on any cluster; no entity is compared with all others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import kg
from lattica.shared import numbered

#: Places that an entity without one is put at: the first so many.
FALLBACK_PLACES = 10


def seeded(salt: str, key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{salt}:"), key))


def number(salt: str, key: Column, seed: int) -> Column:
    """A number below 65536 from the first four digits of the seeded hash."""
    return F.conv(F.substring(seeded(salt, key, seed), 1, 4), 16, 10).cast("long")


def pick(bank: tuple[str, ...], salt: str, key: Column, seed: int) -> Column:
    """One template of the bank."""
    return F.get(F.array(*(F.lit(t) for t in bank)), (number(salt, key, seed) % len(bank)).cast("int"))


def filled(template: Column, **values: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def property_prompts(pairs: DataFrame, bank: DataFrame) -> DataFrame:
    """prompt: every pair(entity, property, category) in every template of its property's category; bank: category, template."""
    return pairs.join(bank, "category").select(filled(F.col("template"), source=F.col("entity")).alias("prompt")).distinct()


def one_property(pairs: DataFrame, seed: int) -> DataFrame:
    """entity, adj: one of its properties."""
    return _one(pairs, "property", seed).withColumnRenamed("property", "adj")


def _one(pairs: DataFrame, value: str, seed: int) -> DataFrame:
    key = F.struct(seeded(value, F.concat_ws(":", "entity", value), seed), F.col(value))
    return pairs.groupBy("entity").agg(F.min_by(value, key).alias(value))


def scene_prompts(pairs: DataFrame, places: DataFrame, bank: tuple[str, ...], seed: int) -> DataFrame:
    """prompt: each entity with one of its properties at one of its places(entity, location), else at one of the first places."""
    own = one_property(pairs, seed).join(_one(places, "location", seed), "entity", "left")
    first = places.select("location").distinct().orderBy("location").limit(FALLBACK_PLACES)
    fallback = first.agg(F.array_sort(F.collect_list("location")).alias("places"))
    own = own.join(F.broadcast(fallback))  # one row of FALLBACK_PLACES names
    at = F.coalesce("location", F.get("places", (number("place", F.col("entity"), seed) % F.greatest(F.size("places"), F.lit(1))).cast("int")), F.lit("a room"))
    return own.select(filled(pick(bank, "scene", F.col("entity"), seed), adj=F.col("adj"), entity=F.col("entity"), location=at).alias("prompt")).distinct()


def meeting_prompts(pairs: DataFrame, places: DataFrame, bank: tuple[str, ...], seed: int) -> DataFrame:
    """prompt: each entity with a place and the next one in a seeded circle, at the first one's place."""
    both = one_property(pairs, seed).join(_one(places, "location", seed), "entity")
    circle = numbered(both, seeded("pair", F.col("entity"), seed), F.col("entity"))
    n = circle.count()
    second = circle.select(F.col("entity").alias("entity2"), F.col("adj").alias("adj2"), F.col("n").alias("next"))
    met = circle.withColumn("next", (F.col("n") + 1) % F.lit(max(n, 1))).join(second, "next").filter("entity <> entity2")
    key = F.concat_ws(":", "entity", "entity2")
    return met.select(filled(pick(bank, "meeting", key, seed), adj1=F.col("adj"), adj2=F.col("adj2"), entity1=F.col("entity"), entity2=F.col("entity2"), location=F.col("location")).alias("prompt")).distinct()


def denial_prompts(edges: DataFrame, nodes: DataFrame, slot: str, bank: tuple[str, ...], per_subject: int, seed: int) -> DataFrame:
    """prompt: each source of edges with seeded targets that it has no such edge to; nodes: id, surface_text."""
    missing = kg.missing_pairs(edges.select(F.col("source_id").alias("subject")).distinct(), edges.select(F.col("target_id").alias("object")), edges, per_subject, seed)
    named = missing.join(nodes.select(F.col("id").alias("subject"), F.col("surface_text").alias("entity")), "subject").join(nodes.select(F.col("id").alias("object"), F.col("surface_text").alias(slot)), "object")
    return named.select(filled(pick(bank, "denial", F.concat_ws(":", "entity", slot), seed), **{"entity": F.col("entity"), slot: F.col(slot)}).alias("prompt")).distinct()


def comparison_prompts(nodes: DataFrame, bank: tuple[str, ...], seed: int) -> DataFrame:
    """prompt: each concept of nodes(id, surface_text, domain, category) and the next of its group in a seeded order."""
    order = numbered(nodes.select("id", "surface_text", "domain", "category"), F.col("domain"), F.col("category"), seeded("compare", F.col("id").cast("string"), seed), F.col("id"))
    after = order.select((F.col("n") - 1).alias("n"), F.col("surface_text").alias("entity2"), "domain", "category")
    pairs = order.join(after, ["n", "domain", "category"])
    return pairs.select(filled(pick(bank, "contrast", F.concat_ws(":", "surface_text", "entity2"), seed), entity1=F.col("surface_text"), entity2=F.col("entity2")).alias("prompt")).distinct()


def entity_prompts(entities: DataFrame, bank: tuple[str, ...], seed: int) -> DataFrame:
    """prompt: one template for each distinct entity."""
    return entities.select("entity").distinct().select(filled(pick(bank, "open", F.col("entity"), seed), entity=F.col("entity")).alias("prompt")).distinct()


def pooled(pools: dict[str, DataFrame]) -> DataFrame:
    """pool, prompt of all pools(prompt)."""
    parts = [p.select(F.lit(k).alias("pool"), "prompt") for k, p in pools.items()]
    return reduce(DataFrame.unionByName, parts)
