"""Contiguous shards of near equal bytes, from global prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, written


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Put all rows into `shards` contiguous shards of near equal bytes (law `bytes`).

    Rows are ordered by text (checksum and the first 60 bits of its MD5) and id, so equal texts stand together, and a large group of copies is
    cut like anything else. Range partitions get the order; each sums its own sizes; the totals, one row a partition,
    are summed up before each partition; a row falls into the shard that holds its middle byte. A shard's bytes differ
    from the mean by one row's size at most. Returns `id_col`, size (UTF-8 bytes plus `overhead`; null text: no bytes
    and checksum 0), text_crc32, law, shard, slot (0, 1, ... in each shard) and grown_shard (null: this law moves rows).
    Null ids come first among equal texts; repeated rows each have a slot; an empty table gives an empty one. Other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("_h"),
        F.monotonically_increasing_id().alias("_nth"),  # tells rows apart that are equal, so that ranges can part them
    )
    order = ["text_crc32", "_h", "_id", "_nth"]
    dealt = written(sized.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "sized")
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_pid").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select(  # a row for each partition
        "_pid",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    here = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumns({"_run": F.sum("size").over(here), "_n": F.row_number().over(here)})
    placed = run.join(totals, "_pid").select(
        "_id", "size", "text_crc32",
        F.expr(f"((2 * (_bytes + _run) - size) * {int(shards)}) div (2 * _all)").cast("int").alias("shard"),
        (F.col("_rows") + F.col("_n") - 1).alias("_row"),
    )
    placed = written(placed, "placed")
    forget(dealt)
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(first, "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
