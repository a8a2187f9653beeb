"""Databases over JDBC: connection options, what they declare, and tables with a row limit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.links import Link
from ..operators.review import declared_link
from ..tables import TableSet

# URL, driver and port of each kind of database.
KINDS = {
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", "com.amazon.redshift.jdbc42.Driver", 5439),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "snowflake": ("jdbc:snowflake://{host}/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", 443),
    "bigquery": ("jdbc:bigquery://https://www.googleapis.com/bigquery/v2:443;ProjectId={database}", "com.simba.googlebigquery.jdbc.Driver", 443),
    "sqlite": ("jdbc:sqlite:{database}", "org.sqlite.JDBC", 0),
}
WITH_CONSTRAINTS = ("postgres", "redshift", "mysql", "sqlserver")


@dataclass(frozen=True)
class Database:
    kind: str
    database: str
    host: str = "localhost"
    port: int | None = None
    user: str | None = None
    password: str | None = None
    schema: str = "public"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of database {self.kind!r}; one of {', '.join(KINDS)}")

    def options(self) -> dict[str, str]:
        url, driver, port = KINDS[self.kind]
        out = {"url": url.format(host=self.host, port=self.port or port, database=self.database), "driver": driver}
        return out | ({"user": self.user} if self.user else {}) | ({"password": self.password} if self.password else {})


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted(kind: str, name: str) -> str:
    if kind in ("mysql", "bigquery"):
        return "`" + name.replace("`", "``") + "`"
    return "[" + name.replace("]", "]]") + "]" if kind == "sqlserver" else '"' + name.replace('"', '""') + '"'


def schema_test(db: Database, column: str) -> str:
    return f"{column} = " + ("DATABASE()" if db.kind == "mysql" else literal(db.schema.upper() if db.kind == "snowflake" else db.schema))


def tables_query(db: Database) -> str:
    if db.kind == "sqlite":
        return "SELECT name AS table_name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'"
    if db.kind == "bigquery":
        return f"SELECT table_name FROM {quoted(db.kind, db.schema)}.INFORMATION_SCHEMA.TABLES WHERE table_type = 'BASE TABLE'"
    return f"SELECT table_name FROM information_schema.tables WHERE {schema_test(db, 'table_schema')} AND table_type = 'BASE TABLE'"


def keys_query(db: Database) -> str:
    """(table, column, place) of primary keys. Constraint names repeat between tables, so tables are joined as well."""
    return (
        "SELECT tc.table_name AS t, kcu.column_name AS c, kcu.ordinal_position AS n FROM information_schema.table_constraints tc "
        "JOIN information_schema.key_column_usage kcu ON tc.constraint_name = kcu.constraint_name AND tc.table_schema = kcu.table_schema "
        f"AND tc.table_name = kcu.table_name WHERE tc.constraint_type = 'PRIMARY KEY' AND {schema_test(db, 'tc.table_schema')}"
    )


def links_query(db: Database) -> str:
    """(from_table, from_col, to_table, to_col) of foreign keys; columns of one key are matched by place."""
    if db.kind == "mysql":
        return (
            "SELECT table_name AS from_table, column_name AS from_col, referenced_table_name AS to_table, referenced_column_name AS to_col "
            f"FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL AND {schema_test(db, 'table_schema')}"
        )
    if db.kind == "sqlserver":
        return (
            "SELECT a.name AS from_table, b.name AS from_col, c.name AS to_table, d.name AS to_col FROM sys.foreign_key_columns f "
            "JOIN sys.tables a ON a.object_id = f.parent_object_id JOIN sys.columns b ON b.object_id = f.parent_object_id AND b.column_id = f.parent_column_id "
            "JOIN sys.tables c ON c.object_id = f.referenced_object_id JOIN sys.columns d ON d.object_id = f.referenced_object_id "
            f"AND d.column_id = f.referenced_column_id WHERE SCHEMA_NAME(a.schema_id) = {literal(db.schema)}"
        )
    return (
        "SELECT x.table_name AS from_table, x.column_name AS from_col, y.table_name AS to_table, y.column_name AS to_col "
        "FROM information_schema.referential_constraints r "
        "JOIN information_schema.key_column_usage x ON x.constraint_name = r.constraint_name AND x.constraint_schema = r.constraint_schema "
        "JOIN information_schema.key_column_usage y ON y.constraint_name = r.unique_constraint_name AND y.constraint_schema = r.unique_constraint_schema "
        f"AND y.ordinal_position = x.position_in_unique_constraint WHERE {schema_test(db, 'r.constraint_schema')}"
    )


def row_limit_query(db: Database, table: str, limit: float = 10_000, with_schema: bool = True) -> str:
    """All columns of at most limit rows; 0 gives the schema alone and infinity all rows."""
    if limit < 0 or limit != limit:
        raise ValueError("a row limit is 0 or more")
    name = quoted(db.kind, table)
    if with_schema and db.kind in ("postgres", "redshift", "sqlserver", "snowflake", "bigquery"):
        name = f"{quoted(db.kind, db.schema)}.{name}"
    if limit == float("inf"):
        return f"SELECT * FROM {name}"
    return f"SELECT TOP ({int(limit)}) * FROM {name}" if db.kind == "sqlserver" else f"SELECT * FROM {name} LIMIT {int(limit)}"


def run_query(spark: SparkSession, db: Database, query: str) -> DataFrame:
    return spark.read.format("jdbc").options(**db.options()).option("query", query).load()


@dataclass
class Introspection:
    tables: list[str]
    keys: dict[str, list[str]]
    links: list[Link]
    notices: list[str]


def introspect(db: Database, run: Callable[[str], DataFrame]) -> Introspection:
    """Tables, primary keys and foreign keys. A query that fails gives nothing and a notice."""
    out = Introspection([], {}, [], [])

    def rows(what: str, query: str) -> list:
        try:
            return [tuple(r) for r in run(query).collect()]
        except Exception as e:
            out.notices.append(f"{what}: {str(e).splitlines()[0][:200]}")
            return []

    out.tables = [r[0] for r in rows("tables", tables_query(db))]
    if db.kind in WITH_CONSTRAINTS:
        for t, c, _ in sorted(rows("primary keys", keys_query(db)), key=lambda r: (r[0], r[2])):
            out.keys.setdefault(t, []).append(c)
        out.links = [declared_link(*r, origin="database", reason="database constraint") for r in rows("foreign keys", links_query(db))]
    return out


def load_tables(db: Database, names: list[str], run: Callable[[str], DataFrame], limit: float = 10_000, keep_empty: bool = True) -> tuple[TableSet, list[str]]:
    """Tables by name; one that can't be read with its schema is tried without. What fails is said, by its first error, and
    so is a table that has as many rows as the limit."""
    out, notices = TableSet(), []
    for n in names:
        first = None
        for with_schema in (True, False):
            try:
                df = run(row_limit_query(db, n, limit, with_schema))
                if keep_empty or limit == 0 or not df.isEmpty():
                    out.add(n, df, source=db.database)
                if 0 < limit < float("inf") and df.count() >= limit:
                    notices.append(f"{n}: only {int(limit):,} rows are read, as the limit says; it may have more")
                break
            except Exception as e:
                first = first or str(e).splitlines()[0][:200]
        else:
            notices.append(f"{n}: {first}")
    return out, notices
