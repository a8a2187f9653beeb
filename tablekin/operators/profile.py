"""Column profiles and value comparison: one pass of plain aggregates, and one shuffle of distinct values.

The second job carries every column's values as 96-bit hashes with a column number: partial aggregation leaves each
partition's distinct values, the shuffle by value brings equal values of all columns together, and from the few columns
that hold a value come, in one aggregate, distinct counts, norms, overlaps and dot products of all pairs of columns. No
candidate pair is joined, so the cost does not grow with their number, and a value met often is one row a column.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FORMAT_SHARE, FORMATS, PRIVATE_SHARE, PRIVATE_VALUES
from ..store import forget, written

STATS = (
    "table string, column string, position int, spark_type string, kind string, n_rows bigint, n_null bigint, "
    "whole boolean, lo double, hi double, len_min int, len_max int, fingerprint string, private string"
)


def kind_of(dtype: T.DataType) -> str | None:
    """numeric, datetime or string, which only compare with their like; None for nested types, which are not compared."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return "string" if isinstance(dtype, T.StringType | T.BooleanType | T.CharType | T.VarcharType) else None


# Expressions are put together as SQL text: building them call by call costs more than running them on small tables.


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_col(field: T.StructField) -> str:
    """The column with NaN as null."""
    c = "`" + field.name.replace("`", "``") + "`"
    return f"nanvl({c}, null)" if isinstance(field.dataType, T.FloatType | T.DoubleType) else c


def sql_whole(c: str) -> str:
    d = f"cast({c} AS double)"
    return f"({d} = cast(floor({d}) AS double) OR abs({d}) = double('infinity'))"


def sql_text(field: T.StructField) -> str:
    """How a value reads: whole numbers without a fraction."""
    c = sql_col(field)
    if isinstance(field.dataType, T.IntegralType):
        return f"cast({c} AS string)"
    if isinstance(field.dataType, T.NumericType):
        small = f"{sql_whole(c)} AND abs(cast({c} AS double)) < 1e18"
        return f"CASE WHEN {small} THEN cast(cast(CASE WHEN {small} THEN {c} END AS bigint) AS string) ELSE cast({c} AS string) END"
    if isinstance(field.dataType, T.BooleanType):
        return f"upper(cast({c} AS string))"
    if isinstance(field.dataType, T.DateType):
        return f"date_format({c}, 'yyyy-MM-dd')"
    return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss')" if kind_of(field.dataType) == "datetime" else f"cast({c} AS string)"


def col_of(field: T.StructField) -> Column:
    return F.expr(sql_col(field))


def as_text(field: T.StructField) -> Column:
    return F.expr(sql_text(field))


def _share(text: str, pattern: str, some: str) -> str:
    return f"try_divide(count_if(rlike({text}, r'{pattern}') AND {some}), count_if({some}))"


def fingerprint(field: T.StructField) -> str:
    """The first format that at least 80 % of the non-null values have.

    Dates and times always read as ISO. Numbers read like codes, zips or phones by their size alone; only fractions are
    matched as text.
    """
    kind, text, c = kind_of(field.dataType), sql_text(field), sql_col(field)
    if kind == "datetime":
        return f"CASE WHEN count({c}) > 0 THEN '{'iso_date' if isinstance(field.dataType, T.DateType) else 'iso_ts'}' END"
    if kind == "numeric":
        small = f"({sql_whole(c)} AND abs(cast({c} AS double)) < 1e18)"
        n = f"cast(CASE WHEN {small} THEN {c} END AS bigint)"
        phone = f"({n} BETWEEN 1000000 AND 999999999999999 OR {n} BETWEEN -99999999999999 AND -100000)"
        fraction = f"rlike(cast({c} AS string), r'{dict(FORMATS)['phone']}')"
        if isinstance(field.dataType, T.IntegralType):
            n, fraction = c, "false"
            small, phone = "true", f"({n} BETWEEN 1000000 AND 999999999999999 OR {n} BETWEEN -99999999999999 AND -100000)"
        tests = {"zip_us": f"{small} AND {n} BETWEEN 10000 AND 99999", "phone": f"CASE WHEN {small} THEN {phone} ELSE {fraction} END", "int_code": f"{small} AND {n} BETWEEN 0 AND 999999"}
        return "CASE " + " ".join(f"WHEN try_divide(count_if({t}), count({c})) >= {FORMAT_SHARE} THEN '{k}'" for k, t in tests.items()) + " END"
    tests = [f"WHEN {_share(text, '(?i)' + p, f'({text}) IS NOT NULL')} >= {FORMAT_SHARE} THEN '{n}'" for n, p in FORMATS]
    return f"CASE {' '.join(tests)} END"


def private_values(field: T.StructField) -> str:
    """What at least 80 % of the trimmed, non-blank values look like, if personal: `NN% of values look like ...`."""
    text = f"trim({sql_text(field)})"
    shares = [(what, _share(text, p, f"{text} <> ''")) for what, p in PRIVATE_VALUES]
    return "CASE " + " ".join(f"WHEN {s} >= {PRIVATE_SHARE} THEN concat(cast(cast(round(100 * {s}) AS int) AS string), '% of values look like {what}')" for what, s in shares) + " END"


def column_stats(name: str, df: DataFrame) -> DataFrame:
    """A row (STATS) for each column of a table, from counts, least and greatest values.

    Each column is an aggregate of its own, which reads that column alone: one of all columns is too long a method for
    the JVM to compile, and several times slower.
    """
    rows = []
    for i, f in enumerate(df.schema):
        c, kind = sql_col(f), kind_of(f.dataType)
        number = f"cast({c} AS double)" if kind == "numeric" else "cast(null AS double)"
        size = f"length({c})" if isinstance(f.dataType, T.StringType) else "cast(null AS int)"
        words = kind == "string" and not isinstance(f.dataType, T.BooleanType)
        parts = {
            "whole": f"min({sql_whole(c)})" if kind == "numeric" else "cast(null AS boolean)",
            "lo": f"min({number})",
            "hi": f"max({number})",
            "len_min": f"min({size})",
            "len_max": f"max({size})",
            "fingerprint": fingerprint(f) if kind else "cast(null AS string)",
            "private": private_values(f) if words else "cast(null AS string)",
        }
        head = {"table": _quoted(name), "column": _quoted(f.name), "position": str(i), "spark_type": _quoted(f.dataType.simpleString()), "kind": _quoted(kind) if kind else "cast(null AS string)"}
        parts = head | {"n_rows": "count(*)", "n_null": f"count(*) - count({c})"} | parts
        rows.append(df.selectExpr(*[f"{v} AS `{k}`" for k, v in parts.items()]))
    return _union(rows)


def length_medians(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, len_median) of text columns with values, from counts of their lengths."""
    parts = []
    for t, df in tables.items():
        rows = [f"named_struct('table', {_quoted(t)}, 'column', {_quoted(f.name)}, 'len', length({sql_col(f)}))" for f in df.schema if isinstance(f.dataType, T.StringType)]
        if rows:
            parts.append(df.selectExpr(f"inline(array({', '.join(rows)}))").where("len IS NOT NULL"))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table string, column string, len_median double")
    counts = _union(parts).groupBy("table", "column", "len").agg(F.count("*").alias("n"))
    one = Window.partitionBy("table", "column")
    run = counts.withColumns({"upto": F.sum("n").over(one.orderBy("len")), "all": F.sum("n").over(one)})
    at = lambda k: F.max(F.expr(f"CASE WHEN upto > {k} AND upto - n <= {k} THEN len END"))
    return run.groupBy("table", "column").agg(((at("(`all` - 1) div 2") + at("`all` div 2")) / 2).alias("len_median"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def columns_of(tables: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
    """Compared columns; the place in this list is a column's number."""
    return [(t, f.name) for t, df in tables.items() for f in df.schema if kind_of(f.dataType)]


def _hashes(field: T.StructField) -> tuple[str, str]:
    """Two hashes of a value; equal numbers of any type have equal ones, and kinds never meet."""
    c, kind = sql_col(field), kind_of(field.dataType)
    if isinstance(field.dataType, T.IntegralType):
        return f"xxhash64('n', cast({c} AS bigint))", f"hash(cast({c} AS bigint))"
    if kind == "numeric":
        d = f"cast({c} AS double)"
        small = f"({sql_whole(c)} AND abs({d}) < 9e18)"
        n = f"cast(CASE WHEN {small} THEN {d} END AS bigint)"
        return f"CASE WHEN {small} THEN xxhash64('n', {n}) ELSE xxhash64('f', {d}) END", f"CASE WHEN {small} THEN hash({n}) ELSE hash({d}) END"
    x = f"cast({c} AS timestamp_ntz)" if kind == "datetime" else sql_text(field)
    return f"xxhash64('{kind[0]}', {x})", f"hash({x})"


def value_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(c, v, w, n): how often each non-null value, as two hashes, occurs in column number c.

    A column is counted by itself, which reads no other: columns of few values stay a few rows, whatever else the table has.
    """
    parts = []
    for i, (t, name) in enumerate(columns_of(tables)):
        f = tables[t].schema[name]
        v, w = _hashes(f)
        own = tables[t].where(f"{sql_col(f)} IS NOT NULL").selectExpr(f"{v} AS v", f"{w} AS w")
        parts.append(own.groupBy("v", "w").agg(F.count("*").alias("n")).select(F.lit(i).alias("c"), "v", "w", "n"))
    return _union(parts)


def own_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(c, n_distinct, square, content) for each column number with values: its distinct count, the square of the norm of
    its counts, and a sum of hashes of its values and their counts. Values of different columns need not meet for this."""
    return value_counts(tables).groupBy("c").agg(
        F.count("*").alias("n_distinct"), F.sum(F.col("n").cast("double") * F.col("n").cast("double")).alias("square"),
        F.sum(F.xxhash64("v", "w", "n").cast("decimal(20,0)")).cast("string").alias("content"),
    )


def pair_counts(counts: DataFrame, groups: list[int] | None = None) -> DataFrame:
    """From value_counts(): (a, b, n_shared, dot, rows_a, rows_b, content) for column numbers a <= b with a value in common;
    if each column's group is given, within groups only.

    dot sums the products of counts; rows_a and rows_b sum the rows of the shared values. For a = b these are what
    own_counts() gives.
    """
    keys = ["v", "w"]
    if groups is not None:
        counts, keys = counts.withColumn("g", F.element_at(F.array(*map(F.lit, groups)), F.col("c") + 1)), ["v", "w", "g"]
    held = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("x"))
    one = held.select(F.explode("x").alias("a"), "x", "v", "w")
    both = one.select("a", "v", "w", F.explode(F.filter("x", lambda y: y["c"] >= F.col("a.c"))).alias("b"))
    n, m = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    return both.groupBy(F.col("a.c").alias("a"), F.col("b.c").alias("b")).agg(
        F.count("*").alias("n_shared"), F.sum(n * m).alias("dot"), F.sum("a.n").alias("rows_a"), F.sum("b.n").alias("rows_b"),
        F.sum(F.when(F.col("a.c") == F.col("b.c"), F.xxhash64("v", "w", "a.n")).cast("decimal(20,0)")).cast("string").alias("content"),
    )


@dataclass
class Profile:
    """What is known of one column."""

    table: str
    column: str
    position: int
    spark_type: str
    kind: str | None
    n_rows: int
    n_null: int
    whole: bool | None
    lo: float | None
    hi: float | None
    len_min: int | None
    len_max: int | None
    fingerprint: str | None
    private: str | None
    len_median: float | None = None
    n_distinct: int = 0
    square: float = 0.0
    content: str | None = None

    @property
    def unique(self) -> bool:
        return self.kind is not None and self.n_rows > 0 and self.n_null == 0 and self.n_distinct == self.n_rows

    @property
    def text(self) -> bool:
        return self.spark_type == "string"

    @property
    def erd_type(self) -> str:
        if self.spark_type == "boolean":
            return "bool"
        if self.kind == "datetime":
            return "date" if self.spark_type == "date" else "datetime"
        return ("float" if self.whole is False else "int") if self.kind == "numeric" else "string"


@dataclass
class Shared:
    n_shared: int = 0
    dot: float = 0.0
    rows_from: int = 0


@dataclass
class Scan:
    """Profiles of all columns and what pairs of columns share. Its size is that of the schema, not of the data."""

    profiles: dict[tuple[str, str], Profile]
    pairs: dict[tuple[tuple[str, str], tuple[str, str]], Shared] = field(default_factory=dict)
    tables: dict[str, list[str]] = field(default_factory=dict)

    def rows(self, table: str) -> int:
        return next((self.profiles[table, c].n_rows for c in self.tables[table]), 0)

    def columns(self, table: str) -> list[Profile]:
        return [self.profiles[table, c] for c in self.tables[table]]

    def shared(self, a: tuple[str, str], b: tuple[str, str]) -> Shared:
        return self.pairs.get((a, b)) or Shared()

    def add_pair(self, a: tuple[str, str], b: tuple[str, str], r) -> None:
        """From a row of pair_counts()."""
        self.pairs[a, b] = Shared(r.n_shared, r.dot, r.rows_a)
        self.pairs[b, a] = Shared(r.n_shared, r.dot, r.rows_b)

    def overlap(self, a: tuple[str, str], b: tuple[str, str]) -> float:
        """The share of a's distinct values that b has."""
        n = self.profiles[a].n_distinct
        return self.shared(a, b).n_shared / n if n else 0.0

    def cosine(self, a: tuple[str, str], b: tuple[str, str]) -> float:
        size = (self.profiles[a].square * self.profiles[b].square) ** 0.5
        return self.shared(a, b).dot / size if size else 0.0


def scan(tables: Mapping[str, DataFrame], content: bool = True, keep: Scan | None = None, changed: set[str] | None = None, values: ValueTables | None = None) -> Scan:
    """Profile tables. Without content only the plain aggregates and each column's own counts are taken, and no values meet.

    With an earlier scan and the tables that have changed since, plain aggregates run on these alone. Values are compared
    again, since a changed table may share them with any other; with `values`, those of unchanged tables are read from
    there instead of being counted anew, and those of changed ones are put there.
    """
    again = {t: df for t, df in tables.items() if keep is None or changed is None or t in changed or t not in keep.tables}
    profiles: dict[tuple[str, str], Profile] = {k: Profile(**v.__dict__) for k, v in (keep.profiles if keep else {}).items() if k[0] in tables and k[0] not in again}
    if stats := [column_stats(t, df) for t, df in again.items() if df.columns]:
        for r in _union(stats).collect():
            profiles[r["table"], r["column"]] = Profile(**r.asDict())
        for r in length_medians(again).collect():
            profiles[r["table"], r["column"]].len_median = r["len_median"]
    out = Scan(profiles, {}, {t: df.columns for t, df in tables.items()})
    names = columns_of(tables)
    if not names:
        return out
    if not content:
        for r in own_counts(tables).collect():
            p = out.profiles[names[r.c]]
            p.n_distinct, p.square, p.content = r.n_distinct, r.square, r.content
        return out
    for r in pair_counts(values.counts(tables, set(again)) if values else value_counts(tables)).collect():
        a, b = names[r.a], names[r.b]
        if r.a == r.b:
            out.profiles[a].n_distinct, out.profiles[a].square, out.profiles[a].content = r.n_shared, r.dot, r.content
        else:
            out.add_pair(a, b, r)
    return out


class ValueTables:
    """The value counts of each table of a set, written to the shared folder, for scans after some of them changed."""

    def __init__(self):
        self.held: dict[str, DataFrame] = {}

    def counts(self, tables: Mapping[str, DataFrame], changed: set[str]) -> DataFrame:
        """value_counts() of tables, counting only those that have changed or aren't held."""
        for t in [t for t in self.held if t in changed or t not in tables]:
            forget(self.held.pop(t))
        for t, df in tables.items():
            if t not in self.held and columns_of({t: df}):
                self.held[t] = written(value_counts({t: df}), "values")
        first, parts = 0, []
        for t, df in tables.items():  # a table's columns have numbers of their own in what is held
            if t in self.held:
                parts.append(self.held[t].withColumn("c", F.col("c") + first))
            first += len(columns_of({t: df}))
        return _union(parts)


def profile_frame(tables: Mapping[str, DataFrame]) -> DataFrame:
    """STATS with n_distinct, is_unique and count_norm for each column, as a DataFrame."""
    stats = _union([column_stats(t, df) for t, df in tables.items() if df.columns])
    names = columns_of(tables)
    spark = stats.sparkSession
    own = own_counts(tables).select(F.col("c").alias("a"), "n_distinct", F.sqrt("square").alias("count_norm"))
    numbered = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(names)], "a int, table string, column string")
    known = stats.join(F.broadcast(numbered), ["table", "column"], "left").join(own, "a", "left")
    n = F.when(F.col("kind").isNotNull(), F.coalesce("n_distinct", F.lit(0)))
    return known.drop("a").withColumns({"n_distinct": n, "is_unique": (F.col("n_rows") > 0) & (F.col("n_null") == 0) & (n == F.col("n_rows")), "count_norm": F.coalesce("count_norm", F.lit(0.0))})


def rounded(x: Column, places: int) -> Column:
    """x to so many decimal places as SQL engines and C round a double: by its own product with a power of ten, not by its
    decimal digits, which differ where a value lies half-way."""
    return F.round(x * F.lit(10.0**places), 0) / F.lit(10.0**places)


def comparison_frame(tables: Mapping[str, DataFrame]) -> DataFrame:
    """For each ordered pair of compared columns of different tables with a value in common: overlap, same_set and cosine."""
    names = columns_of(tables)
    spark: SparkSession = next(iter(tables.values())).sparkSession
    counts = written(pair_counts(value_counts(tables)), "pairs")  # a row a pair of columns
    own = F.broadcast(counts.where("a = b").select(F.col("a").alias("c"), F.col("n_shared").alias("nd"), "dot"))  # a row a column
    numbered = F.broadcast(spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(names)], "c int, t string, col string"))
    two = counts.where("a <> b")
    two = two.select("a", "b", "n_shared", F.col("dot").alias("ab")).unionByName(two.select(F.col("b").alias("a"), F.col("a").alias("b"), "n_shared", F.col("dot").alias("ab")))
    x, y = own.toDF("a", "n1", "s1"), own.toDF("b", "n2", "s2")
    out = two.join(x, "a").join(y, "b").join(numbered.toDF("a", "from_table", "from_col"), "a").join(numbered.toDF("b", "to_table", "to_col"), "b")
    return out.where("from_table <> to_table").select(
        "from_table", "from_col", "to_table", "to_col", "n_shared",
        rounded(F.col("n_shared") / F.col("n1"), 6).alias("overlap"),
        ((F.col("n_shared") == F.col("n1")) & (F.col("n1") == F.col("n2"))).alias("same_set"),
        rounded(F.col("ab") / F.sqrt(F.col("s1") * F.col("s2")), 6).alias("cosine"),
    )


def null_patterns(tables: Mapping[str, DataFrame], scan: Scan, order: str) -> DataFrame:
    """(from_table, from_col, to_table, to_col, r): how the nulls of two columns correlate, row by row, for all pairs of
    columns with nulls and values in different tables of as many rows; rows meet by equal values of the column `order`.

    Only pairs whose tables have all rows in common are given. One shuffle by `order` serves them all: a row there is the
    tables that have it and the columns that are null in it. Rows without a value of `order` meet none.
    """
    some = [(t, p.column) for t in tables if order in scan.tables[t] for p in scan.columns(t) if 0 < p.n_null < p.n_rows and p.column != order]
    names = sorted({t for t, _ in some}, key=list(tables).index)
    spark = next(iter(tables.values())).sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "from_table string, from_col string, to_table string, to_col string, r double")
    parts = []
    for i, t in enumerate(names):
        nulls = [f"CASE WHEN {sql_col(tables[t].schema[c])} IS NULL THEN {j} END" for j, (u, c) in enumerate(some) if u == t]
        key = sql_text(tables[t].schema[order])
        parts.append(tables[t].selectExpr(f"{key} AS k", f"{i} AS t", f"array_compact(array({', '.join(nulls)})) AS x").where("k IS NOT NULL"))
    met = _union(parts).groupBy("k").agg(F.sort_array(F.collect_set("t")).alias("ts"), F.flatten(F.collect_list("x")).alias("x"))
    either = F.array_union(F.transform("ts", lambda t: -1 - t), F.col("x"))  # tables as negative numbers
    pair = met.select(F.explode(either).alias("a"), either.alias("e")).select("a", F.explode("e").alias("b")).where("a < b AND (a < 0) = (b < 0)")
    n = {(r.a, r.b): r.n for r in pair.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}  # a row a pair of columns or tables
    rows = []
    for i, (t, x) in enumerate(some):
        for j, (u, y) in enumerate(some[i + 1 :], i + 1):
            a, b = sorted((-1 - names.index(t), -1 - names.index(u)))
            m = scan.rows(t)
            if t == u or m != scan.rows(u) or n.get((a, b)) != m:
                continue
            p, q, both = scan.profiles[t, x].n_null, scan.profiles[u, y].n_null, n.get((i, j), 0)
            r = (m * both - p * q) / (((m - p) * p) ** 0.5 * ((m - q) * q) ** 0.5)
            rows += [(t, x, u, y, r), (u, y, t, x, r)]
    return spark.createDataFrame(rows, "from_table string, from_col string, to_table string, to_col string, r double")
