"""Registered queries of the subpackage against their SQL on the smallest tables."""

import pytest

from tablekin.llm.queries import ORACLE, QUERIES
from tests.test_queries import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
