"""Streaming forms: record ingest with validation, windowed counts, posting upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lattica.functions.text import record_errors
from lattica.operators.search import postings
from lattica.schemas import MESSAGES


def record_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """messages, errors of JSON lines that arrive in a folder; files_per_trigger sets the pace."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"messages {MESSAGES}").alias("r")).select("r.messages")
    return parsed.withColumn("errors", record_errors(F.col("messages")))


def write_valid(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the records without errors as JSON lines; the checkpoint makes restarts exact."""
    valid = stream.filter(F.size("errors") == 0).select("messages")
    return valid.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n in tumbling windows; events later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


POSTING = "token string, id long, length int, tf long, batch long"


def upsert_postings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep postings of concepts in a folder up to date: each batch adds those of its concepts, which take the place of earlier ones.

    stream: id, surface_text; a null text deletes the concept's postings.  Of several rows of one id in a batch the greatest text counts.
    A batch writes what it brings and nothing else, under its number, so a repeated batch changes nothing; current_postings() reads, compacted() cleans up.
    """

    def put(batch: DataFrame, number: int) -> None:
        one = batch.groupBy("id").agg(F.max("surface_text").alias("surface_text"))
        postings(one.filter("surface_text IS NOT NULL"), "surface_text").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        one.select("id").write.mode("overwrite").parquet(f"{path}/touched/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_postings(spark: SparkSession, path: str) -> DataFrame:
    """token, id, length, tf: the postings that each concept's last batch has written."""
    last = spark.read.schema("id long, batch long").parquet(f"{path}/touched").groupBy("id").agg(F.max("batch").alias("batch"))
    return spark.read.schema(POSTING).parquet(f"{path}/postings").join(last, ["id", "batch"]).select("token", "id", "length", "tf")


def compacted(spark: SparkSession, path: str, out: str) -> None:
    """Write the current postings to another folder as one first batch."""
    now = current_postings(spark, path)
    now.write.mode("overwrite").parquet(f"{out}/postings/batch=-1")
    now.select("id").distinct().write.mode("overwrite").parquet(f"{out}/touched/batch=-1")
