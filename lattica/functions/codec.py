"""Graph-block codec as column expressions: format, parse (lenient and strict), describe in words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.schemas import ID_OF, LABEL_OF

# How each relation reads in words.
RELATION_WORDS = {
    "IsA": "is a type of",
    "HasA": "has",
    "PartOf": "is part of",
    "AtLocation": "is located at",
    "CapableOf": "is capable of",
    "UsedFor": "is used for",
    "HasProperty": "has the property",
    "Causes": "causes",
    "HasPrerequisite": "has the prerequisite",
    "RelatedTo": "is related to",
    "SimilarTo": "is similar to",
    "Antonym": "is the opposite of",
    "Synonym": "is a synonym of",
    "MadeOf": "is made of",
    "DerivedFrom": "is derived from",
    "MannerOf": "is a manner of",
    "MotivatedByGoal": "is motivated by",
    "FormOf": "is a form of",
    "NOT_IsA": "is NOT a type of",
    "NOT_HasA": "does NOT have",
    "NOT_PartOf": "is NOT part of",
    "NOT_AtLocation": "is NOT located at",
    "NOT_CapableOf": "is NOT capable of",
    "NOT_UsedFor": "is NOT used for",
    "NOT_HasProperty": "does NOT have the property",
    "NOT_Causes": "does NOT cause",
    "NOT_HasPrerequisite": "does NOT have the prerequisite",
    "NOT_RelatedTo": "is NOT related to",
    "NOT_SimilarTo": "is NOT similar to",
}
# Format words of questions and their neutral forms, replaced in this order.
NEUTRAL_WORDS = (
    ("According to the SML data, ", "According to the data above, "),
    ("According to the SML data ", "According to the data above "),
    ("Based on the SML data, ", "Based on the data above, "),
    ("Based on the SML data ", "Based on the data above "),
    ("Based on the SML relations, ", "Based on the relationships above, "),
    ("Based on the SML relations ", "Based on the relationships above "),
    ("in the SML block", "in the data above"),
    ("the SML block", "the data above"),
    ("The SML block", "The data above"),
    ("the SML data", "the data above"),
    ("The SML data", "The data above"),
    ("No negation is specified in the SML data", "No negation is specified in the data above"),
    ("Not specified in the SML data", "Not specified in the data above"),
)


def lookup(values: dict, key: Column) -> Column:
    """values[key], null where absent: one map literal, so the plan stays small."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def format_eda(*slots: Column) -> Column:
    """E(a|b|c|d|anchor|mod1|mod2|conf) of exactly eight slots."""
    if len(slots) != 8:
        raise ValueError(f"an entity has 8 slots, not {len(slots)}")
    return F.concat(F.lit("E("), F.concat_ws("|", *(F.coalesce(s.cast("string"), F.lit("0")) for s in slots)), F.lit(")"))


def format_ra(rel_type: Column, source: Column, target: Column, weight: Column, temporal: Column, negated: Column) -> Column:
    """R(label|src|tgt|w|temporal|0): ids become labels, negation a NOT_ prefix."""
    label = F.coalesce(lookup(LABEL_OF, rel_type.try_cast("int")), rel_type.cast("string"))
    label = F.when(negated, F.concat(F.lit("NOT_"), label)).otherwise(label)
    return F.concat(F.lit("R("), F.concat_ws("|", label, source.cast("string"), target.cast("string"), weight.cast("string"), temporal.cast("string"), F.lit("0")), F.lit(")"))


def format_block(entities: Column, relations: Column) -> Column:
    """Entity lines, then relation lines, between the block's tags."""
    return F.concat(F.lit("<sml>\n"), F.array_join(F.concat(entities, relations), "\n"), F.lit("\n</sml>"))


def block_of(text: Column) -> Column:
    """The first block of a text with its tags; empty if none."""
    return F.regexp_extract(text, "(?s)(<sml>.*?</sml>)", 1)


def _slots(block: Column, kind: str) -> Column:
    lines = F.transform(F.split(F.replace(F.replace(block, F.lit("<sml>"), F.lit("")), F.lit("</sml>"), F.lit("")), "\n"), lambda x: F.trim(x))
    own = F.filter(lines, lambda x: x.startswith(f"{kind}(") & x.endswith(")"))
    return F.transform(own, lambda x: F.transform(F.split(F.substring(x, F.lit(3), F.length(x) - 3), "\\|"), lambda y: F.trim(y)))


def parse_entities(block: Column) -> Column:
    """array<array<string>>: the slots of every entity line, of any width."""
    return _slots(block, "E")


def parse_relations(block: Column) -> Column:
    """array<struct<label, rel_type_id, negated, slots>>: a NOT_ prefix becomes negated, the label its last id."""

    def one(s: Column) -> Column:
        raw = F.get(s, F.lit(0))
        negated = raw.startswith("NOT_") | F.coalesce(F.get(s, F.lit(5)).isin("1", "1.0", "True"), F.lit(False))
        label = F.when(raw.startswith("NOT_"), F.substring(raw, F.lit(5), F.length(raw))).otherwise(raw)
        return F.struct(label.alias("label"), F.coalesce(lookup(ID_OF, label), label.try_cast("int")).alias("rel_type_id"), negated.alias("negated"), s.alias("slots"))

    return F.transform(_slots(block, "R"), one)


# The strict grammar, of digits and plain decimals only.
STRICT_ENTITY = r"E\((\d+)\|(\d+)\|(\d+)\|(\d+)\|([^|]+)\|([^|]+)\|(\d+)\|([0-9.]+)\)"
STRICT_RELATION = r"R\(([A-Za-z_]+)\|(\d+)\|(\d+)\|([0-9.]+)\|(\d+)\|(\d+)\)"


def strict_anchors(block: Column) -> Column:
    """Anchors of the entities that fit the strict grammar; others are dropped."""
    return F.regexp_extract_all(block, F.lit(STRICT_ENTITY), F.lit(5))


def strict_relations(block: Column) -> Column:
    """array<struct<label, source, target, weight>> of the relations that fit the strict grammar; one pass finds them, and their slots hold no bar."""
    slots = F.transform(F.regexp_extract_all(block, F.lit(STRICT_RELATION), F.lit(0)), lambda x: F.split(F.substring(x, F.lit(3), F.length(x) - 3), "\\|"))
    return F.transform(slots, lambda x: F.struct(F.get(x, F.lit(0)).alias("label"), F.get(x, F.lit(1)).cast("int").alias("source"), F.get(x, F.lit(2)).cast("int").alias("target"), F.get(x, F.lit(3)).cast("double").alias("weight")))


def name_at(anchors: Column, i: Column) -> Column:
    """The anchor at a 0-based reference; E{i} where it is out of range."""
    return F.coalesce(F.get(anchors, i), F.concat(F.lit("E"), i.cast("string")))


def in_words(block: Column) -> Column:
    """A block in plain sentences; the block itself where it has no entity of the strict grammar."""
    words = lambda label: F.coalesce(lookup(RELATION_WORDS, label), F.lower(F.replace(label, F.lit("_"), F.lit(" "))))

    def told(x: Column) -> Column:
        lines = F.transform(x["relations"], lambda r: F.concat(F.lit("- "), name_at(x["anchors"], r["source"]), F.lit(" "), words(r["label"]), F.lit(" "), name_at(x["anchors"], r["target"]), F.lit(" (confidence: "), r["weight"].cast("string"), F.lit(")")))
        rest = F.when(F.size(x["relations"]) > 0, F.concat(F.lit("Relationships:\n"), F.array_join(lines, "\n"))).otherwise(F.lit("No relationships are defined."))
        text = F.concat(F.lit("The following entities and relationships are defined:\nEntities: "), F.array_join(x["anchors"], ", "), F.lit("\n"), rest)
        return F.when(F.size(x["anchors"]) > 0, text).otherwise(x["block"])

    return let(block, lambda b: let(F.struct(b.alias("block"), strict_anchors(b).alias("anchors"), strict_relations(b).alias("relations")), told))


def neutral(text: Column) -> Column:
    for old, new in NEUTRAL_WORDS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def question_in_words(question: Column) -> Column:
    """A question with its block put in words and its format words made neutral."""

    def told(x: Column) -> Column:
        return F.when(x["inner"] == "", x["question"]).otherwise(neutral(F.replace(x["question"], block_of(x["question"]), in_words(x["inner"]))))

    return let(question, lambda q: let(F.struct(q.alias("question"), F.regexp_extract(q, "(?s)<sml>\n(.*?)\n</sml>", 1).alias("inner")), told))
