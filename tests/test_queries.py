"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tablekin.operators.profile import comparison_frame
from tablekin.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(rows, names):
    def cell(v):
        return "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(spark, query, sql, folder=SF):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got, want = query(spark, folder), con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


def test_shares_round_as_sql_rounds_them(spark):
    """41 / 640 = 0.0640625 is half-way by its digits, but not as a double times a million."""
    tables = {"a": spark.range(640).toDF("x"), "b": spark.range(41).toDF("y")}
    want = duckdb.connect().execute("SELECT round(41 / 640::DOUBLE, 6)").fetchone()[0]
    assert [r.overlap for r in comparison_frame(tables).collect() if r.from_table == "a"] == [want]


def test_columns_are_counted_by_themselves(spark):
    """No row is multiplied by the columns of its table before it is counted."""
    from tablekin.operators.profile import value_counts

    plan = value_counts({"a": spark.range(9).selectExpr("id AS x", "id % 2 AS y")})._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 2
