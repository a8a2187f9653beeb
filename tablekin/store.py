"""Tables between jobs: Parquet in a folder that driver and executors share, so that no executor's loss undoes them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input for each file of a written table, where these make more files than four a core.
FILE_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and Spark is local, a new one."""
    if place := spark.conf.get("spark.checkpoint.dir", None):
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="tablekin-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; the JVM removes it when it ends."""
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{place}/t"


def input_bytes(df: DataFrame) -> int:
    """The bytes of all tables that df reads, as their sources state them."""
    leaves, total = df._jdf.queryExecution().analyzed().collectLeaves().iterator(), 0
    while leaves.hasNext():
        total += int(leaves.next().stats().sizeInBytes())
    return total


def few_files(df: DataFrame) -> DataFrame:
    """df in a partition for FILE_BYTES of its input, or four a core if these are more. Fewer partitions stay as they are.

    Partitions so grow with the data, and a small table dealt over hundreds of partitions doesn't become as many files.
    """
    return df.coalesce(int(min(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // FILE_BYTES)), (1 << 31) - 1)))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and no executor's loss undoes it."""
    spark = df.sparkSession
    few_files(df).write.parquet(place := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(place)
    out._place = place
    return out


def forget(*tables: DataFrame | str) -> None:
    """Delete written() tables, or folders of new_path(), whose readers are done: for what is derived from them, only
    other written tables are read."""
    spark = SparkSession.active()
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._place).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
