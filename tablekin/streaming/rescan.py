"""Keep a discovery up to date while streams append to its tables: an extension built on incremental rescans."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Options
from ..plans.discovery import Discovery, discover, rediscover


@dataclass
class LiveDiscovery:
    """Appends each micro-batch to a table's folder and rescans what has changed.

    A batch is written under its own number, so that a batch that is run again overwrites itself.
    """

    spark: SparkSession
    folder: str
    static: Mapping[str, DataFrame]
    options: Options | None = None
    on_change: Callable[[Discovery, list[str]], None] | None = None
    current: Discovery | None = None

    def rescan(self, streamed: Mapping[str, DataFrame]) -> list[str]:
        tables = {**self.static, **streamed}
        if self.current is None:
            self.current, changed = discover(tables, self.options, composites=False), list(tables)
        else:
            self.current, changed = rediscover(self.current, tables, self.options, composites=False)
        if changed and self.on_change:
            self.on_change(self.current, changed)
        return changed

    def attach(self, name: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start a query that feeds the table `name` from a streaming DataFrame."""

        def batch(df: DataFrame, number: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")
            self.rescan({name: self.spark.read.parquet(f"{self.folder}/{name}").drop("batch")})

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
