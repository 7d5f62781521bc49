"""Text rules of record generation, validation and scoring as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.codec import block_of, let, lookup, parse_entities, parse_relations

# Words never looked up as concepts.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "can", "could", "will", "would",
    "shall", "should", "may", "might", "must", "what", "which", "who", "whom", "where", "when", "why", "how", "you", "your", "i", "me", "my", "we", "our",
    "he", "she", "it", "they", "them", "their", "this", "that", "these", "those", "not", "no", "nor", "and", "or", "but", "if", "then", "so", "of", "in",
    "on", "at", "to", "for", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above", "below", "between", "out",
    "off", "over", "under", "again", "further", "too", "very", "just", "also", "now", "there", "here", "all", "each", "every", "both", "few", "more",
    "most", "other", "some", "such", "only", "own", "same",
)
# Property categories and their seed words.
PROPERTY_SEEDS = {
    "red": 1, "blue": 1, "green": 1, "yellow": 1, "brown": 1, "white": 1, "black": 1, "orange": 1, "purple": 1, "pink": 1, "gray": 1, "grey": 1, "golden":
    1, "silver": 1, "crimson": 1, "scarlet": 1, "violet": 1, "maroon": 1, "turquoise": 1, "beige": 1, "tan": 1, "ivory": 1, "indigo": 1, "magenta": 1,
    "teal": 1, "colorful": 1, "colourful": 1, "multicolored": 1,
    "big": 2, "small": 2, "tall": 2, "deep": 2, "large": 2, "tiny": 2, "huge": 2, "short": 2, "narrow": 2, "wide": 2, "vast": 2, "little": 2, "enormous":
    2, "giant": 2, "massive": 2, "miniature": 2, "petite": 2, "compact": 2, "immense": 2, "thick": 2, "thin": 2,
    "hot": 3, "cold": 3, "warm": 3, "cool": 3, "freezing": 3, "boiling": 3, "chilly": 3, "icy": 3, "lukewarm": 3, "tepid": 3, "scorching": 3,
    "fast": 4, "slow": 4, "quick": 4, "rapid": 4, "swift": 4, "speedy": 4, "sluggish": 4,
    "old": 5, "new": 5, "young": 5, "ancient": 5, "modern": 5, "fresh": 5, "elderly": 5, "youthful": 5, "aged": 5, "juvenile": 5,
    "bright": 6, "dark": 6, "dim": 6, "shiny": 6, "dull": 6, "glowing": 6, "radiant": 6, "luminous": 6, "brilliant": 6, "faint": 6,
    "heavy": 7, "light": 7, "lightweight": 7, "weightless": 7,
    "soft": 8, "hard": 8, "rough": 8, "smooth": 8, "fuzzy": 8, "coarse": 8, "silky": 8, "bumpy": 8, "fluffy": 8, "rigid": 8, "tender": 8, "crispy": 8,
    "sweet": 9, "salty": 9, "bitter": 9, "sour": 9, "spicy": 9, "bland": 9, "savory": 9, "tangy": 9, "delicious": 9, "tasty": 9,
    "round": 10, "long": 10, "flat": 10, "curved": 10, "square": 10, "circular": 10, "oval": 10, "straight": 10, "triangular": 10, "cylindrical": 10,
    "spherical": 10,
    "quiet": 11, "loud": 11, "noisy": 11, "silent": 11, "deafening": 11, "mute": 11,
    "clear": 12, "transparent": 12, "opaque": 12, "murky": 12, "foggy": 12, "cloudy": 12,
    "friendly": 13, "loyal": 13, "independent": 13, "cute": 13, "brave": 13, "gentle": 13, "shy": 13, "kind": 13, "mean": 13, "cruel": 13, "honest": 13,
    "generous": 13, "stubborn": 13, "playful": 13, "aggressive": 13, "calm": 13, "nervous": 13, "lazy": 13, "curious": 13, "clever": 13,
}
# Words of definitions that hint at a property category, in order.
DEFINITION_HINTS = {
    1: ("color", "colour", "hue", "pigment", "chromatic"),
    2: ("size", "extent", "dimension", "stature", "height"),
    3: ("temperature", "thermal", "heat", "warmth", "cold"),
    4: ("speed", "velocity", "pace", "motion"),
    6: ("light", "luminous", "bright", "illuminat"),
    7: ("weight", "mass", "heaviness"),
    8: ("texture", "surface", "touch", "tactile"),
    9: ("taste", "flavor", "palate"),
    10: ("shape", "form", "geometry", "contour"),
    11: ("sound", "noise", "auditory", "acoustic"),
    12: ("clarity", "transparent", "visibility", "optic"),
}
# Words of a question that ask for a property category, in order.
QUERY_WORDS = (
    (1, ("color", "colour", "what color", "what colour")),
    (2, ("how big", "how large", "how small", "size", "how tall")),
    (3, ("hot", "cold", "temperature", "warm", "cool")),
    (4, ("fast", "slow", "speed", "quick")),
    (6, ("bright", "dark", "light")),
    (7, ("heavy", "light", "weight")),
    (8, ("soft", "hard", "texture")),
    (9, ("sweet", "salty", "taste")),
    (10, ("round", "long", "shape")),
    (11, ("quiet", "loud", "sound", "noise")),
    (12, ("clear", "transparent")),
    (13, ("friendly", "loyal", "independent", "cute")),
)
# Phrases by which an answer says that it can't tell.
PUNT_PHRASES = (
    "not enough information",
    "does not contain sufficient",
    "does not contain information",
    "does not provide sufficient",
    "does not provide enough",
    "does not provide information",
    "does not provide a direct",
    "does not directly state",
    "does not directly provide",
    "not possible to determine",
    "cannot be determined",
    "cannot determine",
    "doesn't directly state",
    "no information available",
    "insufficient information",
    "cannot conclusively",
    "we cannot definitively",
    "not explicitly stated",
    "not directly stated",
    "unfortunately, the provided",
    "unfortunately, based on",
    "does not explicitly state",
    "no explicit relation",
    "no direct relation",
    "doesn't provide enough",
)
# Relation names that must not leak into answers, in the order they are looked for.
RELATION_NAMES = (
    "IsA", "PartOf", "HasA", "HasProperty", "CapableOf", "AtLocation", "Causes", "HasPrerequisite", "UsedFor", "CreatedBy", "MadeOf", "Desires",
    "CausesDesire", "RelatedTo", "SimilarTo", "Antonym", "DerivedFrom", "MannerOf", "LocatedNear", "HasContext", "DefinedAs", "SymbolOf",
    "ReceivesAction", "FormOf", "EtymologicallyRelatedTo", "Synonym", "HasFirstSubevent", "HasLastSubevent", "MotivatedByGoal",
)
# Phrases removed from answers, and jargon that answers must not have.
REMOVED_PHRASES = ("SML context", "SML block", "SML data", "anchor token", "confidence score", "provided SML", "the SML")
ANSWER_JARGON = ("SML", "anchor token", "confidence score", "relation type", "entity descriptor", "knowledge base encoding")
RECORD_JARGON = ("SML", "anchor token", "confidence score")
# Gaps that removed words leave, and what they become.
GAPS = ((r"\s*\(\s*\)\s*", " "), (r'"\s*"', ""), (r"\s{2,}", " "))
ANCHOR_LEAK = r"(?U)\b\w+_\d{3,}\b"


def any_of(text: Column, words: tuple | list) -> Column:
    """Whether the text contains any of the words."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def first_of(rules: list[tuple[Column, Column]]) -> Column:
    """The message of the first rule that holds, else null."""
    return F.coalesce(*(F.when(c, m) for c, m in rules))


def all_of(rules: list[tuple[Column, Column]]) -> Column:
    """The messages of all rules that hold."""
    return F.array_compact(F.array(*(F.when(c, m) for c, m in rules)))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(*STOP_WORDS)


def anchor_token(surface: Column, concept_id: Column) -> Column:
    """clean(surface)_id: lower case, spaces and hyphens to _, only letters, digits and _ kept."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(surface), "[ -]", "_"), r"(?U)[^\p{Alnum}_]", "")
    return F.concat_ws("_", clean, concept_id.cast("string"))


def english_term(uri: Column) -> Column:
    """The text of /c/en/some_word(/...); null for other uris."""
    parts = F.split(uri, "/")
    return F.when((F.size(parts) >= 4) & (F.get(parts, F.lit(2)) == "en"), F.replace(F.get(parts, F.lit(3)), F.lit("_"), F.lit(" ")))


def json_weight(metadata: Column) -> Column:
    """The weight of a metadata object, 0 where it can't be read."""
    return F.coalesce(F.get_json_object(metadata, "$.weight").try_cast("double"), F.lit(0.0))


def property_category(surface: Column, definition: Column) -> Column:
    """The category of a seed word, else the first whose hint the definition has, else 0."""
    hints = F.coalesce(*(F.when(any_of(F.lower(definition), ws), F.lit(c)) for c, ws in DEFINITION_HINTS.items()), F.lit(0))
    return F.coalesce(lookup(PROPERTY_SEEDS, F.lower(surface)), hints)


def asked_category(text: Column) -> Column:
    """The property category that a question asks for, by the first group of words that it has."""
    return F.coalesce(*(F.when(any_of(F.lower(text), ws), F.lit(c)) for c, ws in QUERY_WORDS))


def block_quality(block: Column) -> Column:
    """rich, thin or unknown: with relations; with known entities only; with neither."""

    def of(lines: Column) -> Column:
        known = F.exists(lines, lambda x: x.startswith("E(") & ~F.contains(x, F.lit("unknown_")))
        return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(F.exists(lines, lambda x: x.startswith("R(")), "rich").otherwise("thin")

    return let(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), of)


def is_punt(text: Column) -> Column:
    return any_of(F.lower(text), PUNT_PHRASES)


def clean_response(text: Column) -> Column:
    """A response without anchors, relation names and format words, and without the gaps they leave."""
    out = F.regexp_replace(text, ANCHOR_LEAK, "")
    for name in RELATION_NAMES:
        out = F.replace(out, F.lit(name), F.lit(""))
    for phrase in REMOVED_PHRASES:
        out = F.regexp_replace(out, f"(?i){phrase}", "")
    for pattern, to in GAPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def between(text: Column, tag: str) -> Column:
    """The trimmed content of the first element of that tag; null if none."""
    found = F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(F.contains(text, F.lit(f"<{tag}>")) & F.contains(text, F.lit(f"</{tag}>")), F.trim(found))


def after(text: Column, mark: str) -> Column:
    """What follows the first mark, without response tags, trimmed; null if nothing."""
    rest = F.when(F.contains(text, F.lit(mark)), F.regexp_extract(text, f"(?s){mark}(.*)$", 1))
    rest = F.trim(F.replace(F.replace(rest, F.lit("<response>"), F.lit("")), F.lit("</response>"), F.lit("")))
    return F.when(rest != "", rest)


def parse_teacher(text: Column) -> Column:
    """struct<thinking, answer>: by tags, else after the thinking, else halves of the lines."""
    thinking = F.coalesce(between(text, "think"), F.lit(""))
    tagged = F.coalesce(between(text, "response"), F.lit(""))
    answer = F.when(tagged != "", tagged).when(thinking != "", F.coalesce(after(text, "</think>"), F.lit(""))).otherwise("")
    lines = F.split(F.trim(text), "\n")
    half = F.floor(F.size(lines) / 2).cast("int")
    none = (thinking == "") & (answer == "")
    many = F.size(lines) > 2
    head = F.when(many, F.array_join(F.slice(lines, F.lit(1), half), "\n")).otherwise("")
    tail = F.when(many, F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n")).otherwise("")
    return F.struct(F.when(none, head).otherwise(thinking).alias("thinking"), F.when(none, tail).otherwise(answer).alias("answer"))


def _named(text: Column) -> Column:
    """The first relation name that a lower-case text has."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(n.lower())), F.lit(n)) for n in RELATION_NAMES))


def question_error(q: Column) -> Column:
    """The first rule that a question breaks."""
    chars = F.concat(F.lit(" ("), F.length(q).cast("string"), F.lit(" chars)"))
    name = _named(F.lower(q))
    return first_of([
        (q.isNull() | (q == ""), F.lit("empty question")),
        (F.length(q) < 10, F.concat(F.lit("too short"), chars)),
        (F.length(q) > 300, F.concat(F.lit("too long"), chars)),
        (~F.trim(q).endswith("?"), F.lit("does not end with ?")),
        (q.rlike(ANCHOR_LEAK), F.lit("contains anchor token")),
        (name.isNotNull(), F.concat(F.lit("contains relation name '"), name, F.lit("'"))),
    ])


def reasoning_error(r: Column, anchors: Column) -> Column:
    """The first rule that a reasoning breaks; anchors: array<string>."""
    n = F.size(words(r))
    return first_of([
        (r.isNull() | (r == ""), F.lit("empty reasoning")),
        (n < 50, F.concat(F.lit("too short ("), n.cast("string"), F.lit(" words)"))),
        (~F.coalesce(F.exists(anchors, lambda a: (a != "") & F.contains(r, a)), F.lit(False)), F.lit("does not reference any anchor")),
        (~any_of(r, RELATION_NAMES), F.lit("does not reference any relation type")),
    ])


def answer_error(a: Column) -> Column:
    """The first rule that an answer breaks."""
    low = F.lower(a)
    chars = F.concat(F.lit(" ("), F.length(a).cast("string"), F.lit(" chars)"))
    name = _named(low)
    jargon = F.coalesce(*(F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in ANSWER_JARGON))
    return first_of([
        (a.isNull() | (a == ""), F.lit("empty answer")),
        (F.length(a) < 20, F.concat(F.lit("too short"), chars)),
        (F.length(a) > 1000, F.concat(F.lit("too long"), chars)),
        (a.rlike(ANCHOR_LEAK), F.lit("contains anchor token")),
        (name.isNotNull(), F.concat(F.lit("contains relation name '"), name, F.lit("'"))),
        (jargon.isNotNull(), F.concat(F.lit("contains jargon '"), jargon, F.lit("'"))),
        (is_punt(a), F.lit("punt response")),
    ])


def record_errors(messages: Column) -> Column:
    """All rules that a three-turn record breaks: array<string>."""
    part = lambda i, f: F.coalesce(F.get(messages, F.lit(i))[f], F.lit(""))
    user, reply = part(1, "content"), part(2, "content")
    block = block_of(user)
    entities, relations = parse_entities(block), parse_relations(block)
    slots = lambda r, i: F.get(r["slots"], F.lit(i))
    key = F.transform(relations, lambda r: F.concat_ws("|", slots(r, 0), slots(r, 1), slots(r, 2)))
    out = lambda i: F.exists(relations, lambda r: (slots(r, i).try_cast("int") < 0) | (slots(r, i).try_cast("int") >= F.size(entities)))
    think = F.regexp_extract(reply, "(?s)<think>(.*?)</think>", 1)
    has_think = F.contains(reply, F.lit("<think>")) & F.contains(reply, F.lit("</think>"))
    tail = F.when(F.contains(reply, F.lit("</think>")), F.trim(F.element_at(F.split(reply, "</think>"), -1))).otherwise("")
    n_think = F.size(words(think))
    rules = [(part(i, "role") != role, F.lit(f"message {i} should be {role}")) for i, role in enumerate(("system", "user", "assistant"))]
    rules += [
        (block == "", F.lit("user message missing block")),
        (~F.contains(user, F.lit("?")), F.lit("user message missing question")),
        (~has_think, F.lit("assistant missing <think> block")),
        (F.contains(reply, F.lit("<response>")), F.lit("assistant contains <response> tags")),
        ((block != "") & (F.size(relations) == 0), F.lit("block has 0 relations")),
        (F.exists(entities, lambda e: F.size(e) != 8), F.lit("entity width is not 8")),
        (F.exists(relations, lambda r: F.size(r["slots"]) != 6), F.lit("relation width is not 6")),
        (F.size(key) != F.size(F.array_distinct(key)), F.lit("duplicate relation")),
        (out(1), F.lit("source ref out of range")),
        (out(2), F.lit("target ref out of range")),
        (has_think & (n_think < 50), F.concat(F.lit("think block too short ("), n_think.cast("string"), F.lit(" words)"))),
        ((block != "") & (F.size(relations) == 0) & any_of(think, RELATION_NAMES), F.lit("think references a relation but the block has none")),
        (F.length(tail) < 20, F.concat(F.lit("answer too short ("), F.length(tail).cast("string"), F.lit(" chars)"))),
        (tail.rlike(ANCHOR_LEAK), F.lit("answer contains anchor tokens")),
    ]
    rules += [(F.contains(F.lower(tail), F.lit(p.lower())), F.lit(f"answer contains jargon '{p}'")) for p in RECORD_JARGON]
    wrong = F.size(messages) != 3
    return F.when(wrong | messages.isNull(), F.array(F.concat(F.lit("expected 3 messages, got "), F.greatest(F.coalesce(F.size(messages), F.lit(0)), F.lit(0)).cast("string")))).otherwise(all_of(rules))


def convert_record(messages: Column, system_prompt: str) -> Column:
    """A record with its block moved from the assistant's to the user's turn; null if it can't be."""
    question, reply = F.trim(F.get(messages, F.lit(1))["content"]), F.trim(F.get(messages, F.lit(2))["content"])
    block = block_of(reply)
    think = F.coalesce(F.when(between(reply, "think") != "", between(reply, "think")), between(reply, "thinking"), F.lit(""))
    tagged = between(reply, "response")
    answer = F.coalesce(tagged, after(reply, "</think>"), after(reply, "</thinking>"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.when(think != "", F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n\n"), answer)).otherwise(answer)
    out = F.array(turn("system", F.lit(system_prompt)), turn("user", F.concat(block, F.lit("\n\n"), question)), turn("assistant", body))
    return F.when((F.size(messages) >= 3) & (question != "") & (reply != "") & (block != "") & (answer != ""), out)


def score(response: Column, thinking: Column, keywords: Column, anti_keywords: Column) -> Column:
    """PASS, PARTIAL or FAIL by the words that a response should and should not have."""
    low, both = F.lower(response), F.lower(F.concat_ws(" ", response, thinking))
    has = lambda words_, text: F.coalesce(F.exists(words_, lambda k: F.contains(text, F.lower(k))), F.lit(False))
    graded = F.when(has(anti_keywords, low), "FAIL").when(has(keywords, low), "PASS").when(has(keywords, both), "PARTIAL").otherwise("FAIL")
    return F.when(keywords.isNull(), F.when(F.length(response) > 0, "PASS").otherwise("FAIL")).otherwise(graded)


def last_sentences(text: Column, n: int = 3) -> Column:
    parts = F.split(text, r"\. ")
    return F.array_join(F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts), ". ")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")
