from __future__ import annotations

import pytest

import oracle
from quarry.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.SQL[name], SF) == ""
