"""Where iterative operators cut their lineage, and numbering of rows in an order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "file:///tmp/checkpoints"
#: Bytes of input files that a part of spread() stands for, and that a table from cut() may have to be sent whole to every executor.
PART, SMALL = 4 << 20, 16 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir (a local one where a local master has none, as in tests) and read it back."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(named or LOCAL).rstrip('/')}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, as the plan knows them; no job runs."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        leaf = leaves.next()
        if leaf.nodeName().startswith("LogicalRelation"):
            total += int(leaf.stats().sizeInBytes())
    return total


def parts(*inputs: DataFrame) -> int:
    """How many parts the rows of inputs are dealt into, so that one part stays the same size however large the input is."""
    least = int(inputs[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(input_bytes(x) for x in inputs) // PART))


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df dealt by keys into n parts (by the size of its files): groups, windows and joins by the keys that follow need no further exchange."""
    return df.repartition(n or parts(df), *keys)


def sent(df: DataFrame) -> DataFrame:
    """df, a result of cut(), marked for broadcast where its files are small."""
    return F.broadcast(df) if input_bytes(df) <= SMALL else df


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """df with name: its rows' number (from 0) in the order given, which must tell rows apart to be stable.

    Rows are dealt by range and numbered in each part; the driver sees only how many each part has.
    """
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    dealt = df.select("*", *keys).repartitionByRange(*names).sortWithinPartitions(*names)
    # the id counts rows in a part from 0 in its lower 33 bits
    placed = cut(dealt.withColumn("_id", F.monotonically_increasing_id()).drop(*names))
    part, row = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for r in placed.groupBy(part).count().orderBy("_part").collect():
        offsets.append((r["_part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return placed.select(*df.columns, part, row.alias("_row")).join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_before") + F.col("_row")).alias(name))
