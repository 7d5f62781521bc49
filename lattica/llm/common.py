"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.  Only a local master goes without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


#: Bytes that one batch between the JVM and Python holds, so that long texts don't add up in a worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session hand rows to Python in batches of BATCH_BYTES at most; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def released() -> None:
    """Give memory that a worker has freed back to the system: workers wait for other tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.  freed() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def cut_bucketed(df: DataFrame, keys: list[str], buckets: int, what: str) -> DataFrame:
    """cut(), as a table of hash buckets by keys: joins on them don't exchange it again."""
    spark = df.sparkSession
    name = f"lattica_{what.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    # the number of tasks is the number of buckets, so each writes one file
    df.repartition(buckets, *keys).write.option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    out = spark.table(name)
    out._cut_path = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete what cut() wrote for tables that nothing reads any more, and let Spark drop the shuffle files of finished jobs."""
    spark = tables[0].sparkSession
    jvm = spark._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    jvm.System.gc()


def carried(df: DataFrame, *own: str) -> DataFrame:
    """The columns own, and all others in one struct _row, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in own]
    return df.select(*own, F.struct(*rest or [F.lit(0).alias("none")]).alias("_row"))


def uncarried(df: DataFrame, columns: list[str], own: tuple[str, ...], added: dict) -> DataFrame:
    """The columns of the input, own ones from df and others from _row, and those added; an added column takes
    the place of an input column of its name, whatever the case."""
    new = {c.lower() for c in added}
    kept = [F.col(f"`{c}`") if c in own else F.col("_row").getField(c).alias(c) for c in columns if c.lower() not in new]
    return df.select(*kept, *(e.alias(c) for c, e in added.items()))


def parts_for(df: DataFrame, column: str, mb: float, least: int = 1) -> int:
    """How many groups of about mb megabytes the text of column makes, over all rows."""
    total = df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(least, int(-(-total // int(mb * 1e6))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
