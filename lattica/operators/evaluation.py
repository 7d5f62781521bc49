"""Question sets and their scores: pairs of files, task binding, injection of blocks, accuracy and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.functions.codec import block_of
from lattica.operators.prompts import pick

QUESTION = "question string, choices array<string>, answer int, category string, difficulty string, reasoning_type string, num_entities int, num_relations int, num_hops int"
#: Characters that a rephrased question may have, and the entity that it must keep.
REPHRASED, KEPT = 500, "X0"
# Bounds of the accuracy bands, in hundredths.
PLAIN_BANDS = ((70, "too easy"), (50, "moderate"), (30, "in range"))
TUNED_BANDS = ((65, "well handled"), (34.999999, "in range"))


def questions(lines: DataFrame) -> DataFrame:
    """line and the fields of each question of lines(line, value); blank lines are skipped."""
    return lines.filter(F.trim("value") != "").select("line", F.from_json("value", QUESTION).alias("q")).select("line", "q.*")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """line, a, b: the rows of two question sets by their place; sets of different sizes are an error."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} questions against {m}")
    one = a.select("line", F.struct(*[c for c in a.columns if c != "line"]).alias("a"))
    return one.join(b.select("line", F.struct(*[c for c in b.columns if c != "line"]).alias("b")), "line")


def bound(rows: DataFrame, template: str, choices: str, target: str) -> DataFrame:
    """prompt, choices, target of rows for a task: {{name}} in the template is filled from the column of that name."""
    prompt: Column = F.lit(template)
    for c in rows.columns:
        if "{{" + c + "}}" in template:
            prompt = F.replace(prompt, F.lit("{{" + c + "}}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(prompt.alias("prompt"), F.col(choices).alias("choices"), F.col(target).cast("int").alias("target"))


def choice_kind(key: Column, kinds: tuple[str, ...]) -> Column:
    """One of the kinds by a hash of the key, the same in every process."""
    return pick(kinds, "kind", key.cast("string"), 0)


def has_relations(block: Column) -> Column:
    return F.contains(block, F.lit("\nR("))


def split_question(question: Column) -> Column:
    """struct<block, asked, choices>: the parts of an assembled question; choices are its lettered lines."""
    parts = F.split(question, "</sml>\n\n", 2)
    whole = F.size(parts) == 2
    lines = F.split(F.when(whole, F.get(parts, F.lit(1))).otherwise(question), "\n")
    lettered = lambda x: x.rlike("^[A-D]\\) ")
    return F.struct(F.when(whole, F.concat(F.get(parts, F.lit(0)), F.lit("</sml>"))).otherwise("").alias("block"), F.array_join(F.filter(lines, lambda x: ~lettered(x)), "\n").alias("asked"), F.filter(lines, lettered).alias("choices"))


def accepted_rephrase(new: Column) -> Column:
    """Whether a rephrased question may be used."""
    return F.coalesce((F.length(new) <= REPHRASED) & F.trim(new).endswith("?") & F.contains(new, F.lit(KEPT)), F.lit(False))


def rephrased(question: Column, new: Column) -> Column:
    """The question with its wording replaced, if the new one is accepted; block and choices stay."""
    p = split_question(question)
    built = F.concat_ws("\n", F.concat(p["block"], F.lit("\n\n"), F.trim(new)), p["choices"])
    return F.when(accepted_rephrase(new), built).otherwise(question)


def rendered(messages: Column, template: str = "<|{role}|>\n{content}\n") -> Column:
    """A chat as one text by the template of a turn."""
    return F.array_join(F.transform(messages, lambda m: F.replace(F.replace(F.lit(template), F.lit("{role}"), m["role"]), F.lit("{content}"), m["content"])), "")


def system_prefix(rendered_text: Column, sentinel: str) -> Column:
    """What a rendered chat has before the sentinel that stands for the user's text."""
    return F.get(F.split(rendered_text, F.lit("\\Q" + sentinel + "\\E"), 2), F.lit(0))


def injected(requests: DataFrame, blocks: DataFrame, prefix: str, tail: int = 2048) -> DataFrame:
    """requests(request_id, context) with context: the prefix once, then the block of the context's tail, then the context.

    blocks: snippet, block; distinct snippets are encoded once elsewhere.  Contexts that have the prefix keep it; those without a block go on unchanged.
    """
    snippet = F.substring("context", -tail, tail) if tail else F.col("context")
    found = requests.withColumn("snippet", F.when(F.length("context") > tail, snippet).otherwise(F.col("context"))).join(blocks, "snippet", "left")
    body = F.when(F.coalesce("block", F.lit("")) != "", F.concat("block", F.lit("\n\n"), "context")).otherwise(F.col("context"))
    return found.select("request_id", F.when(F.startswith("context", F.lit(prefix)), F.col("context")).otherwise(F.concat(F.lit(prefix), body)).alias("context"))


def accuracies(answers: DataFrame) -> DataFrame:
    """run, n, acc, acc_norm of answers(run, question_id, target, scores array<double>, lengths array<int>).

    A question is right where the target has the highest score, or, for acc_norm, the highest score by length; the first among equals counts.
    """
    best = lambda x: F.array_position(x, F.array_max(x)) - 1
    norm = F.transform(F.arrays_zip("scores", "lengths"), lambda z: z["scores"] / F.greatest(z["lengths"], F.lit(1)))
    right = lambda x: F.avg((best(x) == F.col("target")).cast("double"))
    return answers.groupBy("run").agg(F.count("*").alias("n"), right(F.col("scores")).alias("acc"), right(norm).alias("acc_norm"))


def deltas(answers: DataFrame, base: str) -> DataFrame:
    """run, acc, delta: every run against the base run."""
    a = accuracies(answers)
    return a.join(F.broadcast(a.filter(F.col("run") == base).select(F.col("acc").alias("_base"))), how="left").select("run", "acc", (F.col("acc") - F.col("_base")).alias("delta"))


def run_matrix(scores: DataFrame, models: list[str]) -> DataFrame:
    """format and a column of accuracy for each model, of scores(model, format, acc)."""
    return scores.groupBy("format").pivot("model", models).agg(F.max("acc"))


def band(acc: Column, bands: tuple[tuple[float, str], ...], rest: str) -> Column:
    """The first band whose bound the accuracy is above."""
    out = F.lit(rest)
    for bound_, name in reversed(bands):
        out = F.when(acc * 100 > bound_, name).otherwise(out)
    return F.when(acc.isNotNull(), out)


def token_report(pairs: DataFrame) -> DataFrame:
    """Sums and ratios of paired(): n, tokens and characters of blocks against the same in words, mean and summed ratio.

    pairs: a.question has a block, b.question the words before its last question.
    """
    block = block_of(F.col("a.question"))
    words = F.get(F.split(F.col("b.question"), "\n\n"), F.lit(0))
    p = pairs.select(F.inline(F.array(F.struct(block.alias("block"), words.alias("words"))))).filter("block <> ''")
    block, words = F.col("block"), F.col("words")
    p = p.select(text.estimated_tokens(block).alias("x"), text.estimated_tokens(words).alias("y"), F.length(block).alias("cx"), F.length(words).alias("cy"))
    return p.agg(F.count("*").alias("n"), F.sum("x").alias("block_tokens"), F.sum("y").alias("word_tokens"), F.sum("cx").alias("block_chars"), F.sum("cy").alias("word_chars"), F.avg(text.ratio(F.col("x"), F.col("y"))).alias("mean_ratio"), text.ratio(F.sum("x"), F.sum("y")).alias("ratio_of_sums"))
