"""Chat records: assembly, validation against the graph, splits, budgets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.codec import block_of, parse_entities, parse_relations
from lattica.operators.kg import hashed
from lattica.shared import numbered, spread


def v1_errors(records: DataFrame, concepts: DataFrame) -> DataFrame:
    """line, errors, warnings of records(line, messages) whose block, thinking and answer are in the last turn.

    Anchors are looked up in concepts by one anti-join of all records' anchors.
    """
    last = F.get("messages", F.size("messages") - 1)
    text = F.coalesce(last["content"], F.lit(""))
    # generated rows keep each step from being worked out again for every use of it
    r = records.select("line", "messages", F.explode(F.array(text)).alias("text"))
    r = r.select("line", "messages", "text", F.explode(F.array(block_of(F.col("text")))).alias("block"))
    early = F.when(F.col("messages").isNull(), "missing messages").when(F.size("messages") < 3, "need at least 3 messages").when(last["role"] != "assistant", "last message must be assistant").when(F.col("block") == "", "missing block")
    r = r.select("line", "text", "block", F.inline(F.array(F.struct(early.alias("early"), parse_entities(F.col("block")).alias("e")))))
    known = F.filter(F.transform(F.filter("e", lambda x: F.size(x) == 8), lambda x: F.get(x, F.lit(4))), lambda a: ~a.startswith("unknown_") & a.try_cast("double").isNull())
    anchors = r.filter("early IS NULL").select("line", F.explode(F.array_distinct(known)).alias("anchor_token"))
    unknown = anchors.join(concepts.select("anchor_token").distinct(), "anchor_token", "left_anti")
    unknown = unknown.groupBy("line").agg(F.transform(F.array_distinct(F.array_sort(F.collect_list("anchor_token"))), lambda a: F.concat(F.lit("anchor '"), a, F.lit("' not in graph"))).alias("unknown"))
    r = r.select("line", "text", "early", "e", F.explode(F.array(parse_relations(F.col("block")))).alias("r"))
    conf = lambda x: F.get(x, F.lit(7)).try_cast("double")
    ref = lambda x, i: F.get(x["slots"], F.lit(i)).try_cast("int")
    bad = lambda i: F.exists("r", lambda x: (F.size(x["slots"]) == 6) & ((ref(x, i) < 0) | (ref(x, i) >= F.size("e"))))
    has = lambda tag: F.contains("text", F.lit(f"<{tag}>")) & F.contains("text", F.lit(f"</{tag}>"))
    think = F.trim(F.regexp_extract("text", "(?s)<think>(.*?)</think>", 1))
    rules = [
        (~has("think"), "missing think block"), (~has("response"), "missing response block"),
        (F.exists("e", lambda x: F.size(x) != 8), "entity width is not 8"), (F.exists("e", lambda x: (F.size(x) == 8) & ~conf(x).between(0, 1)), "confidence out of [0,1]"),
        (F.exists("r", lambda x: F.size(x["slots"]) != 6), "relation width is not 6"), (bad(1), "subject_ref out of range"), (bad(2), "object_ref out of range"),
    ]
    own = F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in rules)))
    n_think = F.size(F.filter(F.split(think, r"\s+"), lambda w: w != ""))
    warn = F.array_compact(F.array(F.when(has("think") & (n_think < 20), F.lit("think block too short"))))
    out = r.join(unknown, "line", "left")
    errors = F.when(F.col("early").isNotNull(), F.array("early")).otherwise(F.concat(own, F.coalesce("unknown", F.array().cast("array<string>"))))
    return out.select("line", errors.alias("errors"), F.when(F.col("early").isNull(), warn).otherwise(F.array().cast("array<string>")).alias("warnings"))


def validation_summary(errors: DataFrame) -> DataFrame:
    """total, valid, invalid, valid_pct of line, errors."""
    n, good = F.count("*"), F.sum(F.when(F.size("errors") == 0, 1).otherwise(0))
    return errors.agg(n.alias("total"), F.coalesce(good, F.lit(0)).alias("valid"), (n - F.coalesce(good, F.lit(0))).alias("invalid"), F.round(100 * F.coalesce(good, F.lit(0)) / F.greatest(n, F.lit(1)), 1).alias("valid_pct"))


def split(records: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """records with part = test for about share of the keys, by their hash: the same on any cluster."""
    return records.withColumn("part", F.when(hashed(F.col(key), seed) < int(share * (1 << 32)), "test").otherwise("train"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with place, their rank (from 1) in a seeded order."""
    return numbered(rows, hashed(F.col(key), seed), F.col(key), name="place").withColumn("place", (F.col("place") + 1).cast("int"))


def quota_sample(pool: DataFrame, shares: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows of pool(category, key): each category's share first, then the overflow of all by seeded rank, then over again.

    shares: category, share.  Returns category, key, nth (1 to n); the pool repeats when it has fewer than n rows.
    """
    h = hashed(F.col("key"), seed)
    r = pool.join(shares, "category").withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(h, "key")))
    r = r.withColumn("target", F.greatest(F.lit(1), F.floor(F.col("share") * n).cast("int"))).withColumn("over", (F.col("r") > F.col("target")).cast("int"))
    first = r.orderBy("over", h, "category", "key").limit(n).select("category", "key", F.row_number().over(Window.orderBy("over", h, "category", "key")).alias("nth"))
    size = first.count()
    if not size or size >= n:
        return first
    again = first.select("category", "key", F.explode(F.sequence(F.lit(0), F.lit(-(-n // size) - 1))).alias("turn"), "nth")
    return again.select("category", "key", (F.col("turn") * size + F.col("nth")).alias("nth")).filter(F.col("nth") <= n)


def with_total(counts: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    """Aggregates of each group and of all (TOTAL)."""
    return counts.rollup(by).agg(F.grouping(by).alias("_g"), *aggregates).withColumn(by, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(by))).drop("_g")


def recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """key, missing, status of truth(key, expected array<string>) against found(key, value)."""
    got = found.groupBy("key").agg(F.collect_set("value").alias("got"))
    t = truth.join(got, "key", "left").withColumn("missing", F.array_sort(F.array_except("expected", F.coalesce("got", F.array().cast("array<string>")))))
    return t.select("key", "missing", F.when(F.col("got").isNull(), "MISSING_CONCEPT").when(F.size("missing") == 0, "PASS").otherwise("MISSING").alias("status"))


def fill_templates(pairs: DataFrame, templates: DataFrame) -> DataFrame:
    """Every pair in every template of its kind: pairs(kind, source, target), templates(kind, template); {source} and {target} are filled.

    Equal pairs are joined before they are filled, and a kind's few templates are one broadcast row, whose equal prompts for a pair fall
    together in the row: no prompt crosses an exchange.
    """
    bank = templates.groupBy("kind").agg(F.collect_set("template").alias("_t"))
    filled = F.transform("_t", lambda t: F.replace(F.replace(t, F.lit("{source}"), F.col("source")), F.lit("{target}"), F.col("target")))
    asked = pairs.select("kind", "source", "target").join(F.broadcast(bank.select("kind")), "kind", "left_semi")
    j = spread(asked, "kind", "source", "target").distinct().join(F.broadcast(bank), "kind")
    return j.select("kind", "source", "target", F.explode(F.array_distinct(filled)).alias("prompt"))


def first_of_duplicates(prompts: DataFrame, text: str, order: str) -> DataFrame:
    """The first of prompts that are equal but for case."""
    first = F.min_by(F.struct(*prompts.columns), order)
    return spread(prompts.withColumn("_key", F.lower(text)), "_key").groupBy("_key").agg(first.alias("_p")).select("_p.*")


def shuffle_choices(choices: Column, answer: Column, key: Column, seed: int) -> Column:
    """struct<choices, answer>: choices in a seeded order, and where the right one (0-based answer) went."""
    marked = F.transform(choices, lambda c, i: F.struct(hashed(key * 31 + i * 7919, seed).alias("h"), i.alias("i"), c.alias("c")))
    mixed = F.array_sort(marked)
    return F.struct(F.transform(mixed, lambda x: x["c"]).alias("choices"), (F.array_position(F.transform(mixed, lambda x: x["i"]), answer) - 1).cast("int").alias("answer"))


def question_text(block: Column, question: Column, choices: Column) -> Column:
    """Block, question and lettered choices."""
    lines = F.transform(choices, lambda c, i: F.concat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), F.lit(") "), c))
    return F.concat(block, F.lit("\n\n"), question, F.lit("\n"), F.array_join(lines, "\n"))


def question_errors(question: Column, choices: Column, answer: Column) -> Column:
    """What is wrong with a multiple-choice question: array<string>."""
    rules = [(question.isNull() | ~F.contains(question, F.lit("<sml>")), "no block"), (F.size(choices) != 4, "not 4 choices"), (F.size(F.array_distinct(choices)) != F.size(choices), "equal choices"), (~answer.between(0, 3), "answer out of range")]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in rules)))
