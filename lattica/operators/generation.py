"""Training records around completions that a hosted model has given: assembly, validation, statistics, manifest.

The model is outside: completions come as a table, or from a function that is called with retries.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import codec, text
from lattica.operators.kg import admitted

# Response tags that models spell wrong.
BROKEN_TAGS = "</?s?p?o?n?s?e?response>|</?sresponse>|</?sponse>|</?response>"


def with_retries(call: Callable[[str], str], attempts: int = 5, first: float = 1.0, longest: float = 60.0, wait: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """call, tried again after waits that double from first to longest with up to half as much at random; None when all fail."""

    def run(x: str) -> str | None:
        for i in range(attempts):
            try:
                return call(x)
            except Exception:  # whatever the service raises
                if i + 1 < attempts:
                    pause = min(longest, first * 2**i)
                    wait(pause + random.uniform(0, pause / 2))
        return None

    return run


def completed(requests: DataFrame, call: Callable[[str], str], attempts: int = 5, first: float = 1.0) -> DataFrame:
    """request, completion of requests(request): each distinct request is called once, null where every try fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = with_retries(call, attempts, first)
        for b in batches:
            yield pd.DataFrame({"request": b["request"], "completion": [ask(x) for x in b["request"]]})

    return requests.select("request").distinct().mapInPandas(run, "request string, completion string")


def parsed_output(output: Column) -> Column:
    """struct<thinking, response> of a model's output: tagged, else what follows the thinking, else all but the block."""
    thinking = F.coalesce(text.between(output, "think"), F.lit(""))
    tagged = F.coalesce(text.between(output, "response"), F.lit(""))
    rest = F.when((thinking != "") & F.contains(output, F.lit("</think>")), F.trim(F.regexp_extract(output, "(?s)</think>(.*)$", 1))).otherwise("")
    plain = F.trim(F.regexp_replace(output, "(?s)<sml>.*?</sml>", ""))
    response = F.when(tagged != "", tagged).when(rest != "", rest).otherwise(plain)
    return F.struct(thinking.alias("thinking"), F.trim(F.regexp_replace(response, BROKEN_TAGS, "")).alias("response"))


def _turns(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns))


def first_records(prompts: DataFrame, completions: DataFrame, system: str, order: str) -> DataFrame:
    """V1 records: prompt, quality, messages of prompts(prompt, block, any order column) that are admitted and answered.

    Blocks are admitted by quality within the budget; completions(prompt, completion) are split into thinking and answer; answers that
    give up, or are empty when cleaned, are left out.  The block, thinking and answer are the last turn.
    """
    p = prompts.select("*", F.explode(F.array(text.block_quality(F.col("block")))).alias("quality"))
    a = admitted(p, "quality", order, prompts.count()).join(completions, "prompt")
    # generated rows keep each step from being worked out again for every use of it
    a = a.select("prompt", "quality", "block", F.inline(F.array(text.parse_teacher(F.col("completion"))))).filter(~text.is_punt(F.col("answer")))
    a = a.select("prompt", "quality", "block", "thinking", F.explode(F.array(text.clean_response(F.col("answer")))).alias("answer")).filter("answer <> ''")
    last = F.concat(F.col("block"), F.lit("\n<think>\n"), F.col("thinking"), F.lit("\n</think>\n<response>\n"), F.col("answer"), F.lit("\n</response>"))
    return a.select("prompt", "quality", _turns(("system", F.lit(system)), ("user", F.col("prompt")), ("assistant", last)).alias("messages"))


def staged_records(clusters: DataFrame, completions: DataFrame, system: str) -> DataFrame:
    """V3 records: cluster, category, messages, retries, error (the first rule broken, null for a good record).

    clusters: cluster, category, block.  completions: cluster, question, reasoning, answer, retries; a cluster without one has
    failed.  The stages are checked in turn, then the whole record.
    """
    x = clusters.join(completions, "cluster", "left").withColumn("anchors", codec.strict_anchors(F.col("block")))
    user = F.concat("block", F.lit("\n\n"), "question")
    reply = F.concat(F.lit("<think>\n"), F.col("reasoning"), F.lit("\n</think>\n\n"), F.col("answer"))
    x = x.withColumn("messages", _turns(("system", F.lit(system)), ("user", user), ("assistant", reply)))
    stage = lambda name, error: F.when(error.isNotNull(), F.concat(F.lit(f"{name}: "), error))
    whole = F.get(text.record_errors(F.col("messages")), F.lit(0))
    error = F.coalesce(stage("question", text.question_error(F.col("question"))), stage("reasoning", text.reasoning_error(F.col("reasoning"), F.col("anchors"))), stage("answer", text.answer_error(F.col("answer"))), stage("record", whole))
    return x.select("cluster", "category", F.when(error.isNull(), F.col("messages")).alias("messages"), F.coalesce("retries", F.lit(0)).alias("retries"), error.alias("error"))


def generation_stats(records: DataFrame) -> DataFrame:
    """category, generated, failed, retries, and TOTAL."""
    good = F.count(F.when(F.col("error").isNull(), 1))
    g = records.rollup("category").agg(F.grouping("category").alias("_g"), good.alias("generated"), (F.count("*") - good).alias("failed"), F.coalesce(F.sum("retries"), F.lit(0)).cast("long").alias("retries"))
    return g.withColumn("category", F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("category"))).drop("_g")


def manifest(records: DataFrame, requested: dict[str, int], seconds: float = 0.0) -> dict:
    """What a run asked for and got: a small dictionary for a JSON file."""
    rows = {r["category"]: r.asDict() for r in generation_stats(records).collect()}  # a row for each category
    total = rows.pop("TOTAL", {"generated": 0, "failed": 0, "retries": 0})
    return {"requested": requested, "generated": total["generated"], "failed": total["failed"], "retries": total["retries"], "by_category": {k: v["generated"] for k, v in sorted(rows.items())}, "seconds": seconds}


def write_summary(spark, summary: dict, path: str) -> None:
    """One JSON file's folder with the summary."""
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
