"""A set of named tables in a fixed order, and what happens when names collide or contents change."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.naming import clean_names


@dataclass
class TableSet(Mapping):
    """name -> DataFrame, in order. Data stays in Spark; only names and counts are held here."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    renames: list[tuple[str, str, str, str]] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> TableSet:
        return cls({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None) -> TableSet:
        """All tables and views of a catalog database."""
        found = spark.catalog.listTables(database) if database else spark.catalog.listTables()
        return cls({t.name: spark.table(f"{database}.{t.name}" if database and not t.isTemporary else t.name) for t in found})

    def add(self, name: str, df: DataFrame, on_conflict: str = "overwrite", source: str = "", clean: bool = True, skip_equal: bool = False) -> str | None:
        """Add a table under its clean name, with clean column names; changes of names are logged.

        If the name is taken: overwrite replaces, keep_both adds _2, _3, ..., skip leaves the present table. Returns the
        name in use, or None if skipped. With skip_equal, a table with the content of the present one is skipped
        whatever the policy.
        """
        if on_conflict not in ("overwrite", "keep_both", "skip"):
            raise ValueError(f"unknown conflict policy {on_conflict!r}")
        new = name
        if clean:
            (new,) = clean_names([name])
            cols = clean_names(df.columns)
            if new != name:
                self.renames.append(("table", source or name, name, new))
            self.renames += [("column", source or name, a, b) for a, b in zip(df.columns, cols, strict=True) if a != b]
            df = df.toDF(*cols)
        if new in self.tables and (on_conflict == "skip" or (skip_equal and signature(df).first() == signature(self.tables[new]).first())):
            return None
        if new in self.tables and on_conflict == "keep_both":
            new = next(f"{new}_{k}" for k in range(2, len(self) + 3) if f"{new}_{k}" not in self.tables)
        self.tables[new] = df
        return new

    def remove(self, name: str) -> None:
        self.tables.pop(name, None)

    def with_rows(self) -> TableSet:
        """The tables that have rows."""
        return TableSet({n: df for n, df in self.items() if not df.isEmpty()}, self.renames)

    def rename_log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.renames, "object_type string, source string, original_name string, cleaned_name string")

    def narrowed(self, most: int) -> TableSet:
        """Tables of at most `most` columns: those named like ids first, then others in order."""
        from .functions.naming import ID_LIKE, clean_name

        def few(df: DataFrame) -> DataFrame:
            ids = [c for c in df.columns if ID_LIKE.search(clean_name(c))]
            keep = set((ids + [c for c in df.columns if c not in ids])[:most])
            return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep])

        return TableSet({n: few(d) if len(d.columns) > most else d for n, d in self.items()}, self.renames)


def signature(df: DataFrame) -> DataFrame:
    """One row (n_rows, content, schema) that changes with the content, whatever the order of rows."""
    shape = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return df.select(F.xxhash64(*[F.to_json(F.struct(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema]).alias("h")).agg(
        F.count("*").alias("n_rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("content"), F.lit(shape).alias("schema")
    )


def signatures(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows, content, schema) of each table, as one job."""
    parts = [signature(df).select(F.lit(name).alias("table"), "*") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changed_tables(tables: Mapping[str, DataFrame], known: Mapping[str, tuple]) -> tuple[list[str], dict[str, tuple]]:
    """Names of tables that are new or whose signature differs from the known one, and all present signatures."""
    if not tables:
        return [], {}
    now = {r["table"]: (r.n_rows, r.content, r.schema) for r in signatures(tables).collect()}
    return [n for n in tables if now[n] != known.get(n)], now
