"""Corpus queries against their SQL on the smallest tables."""

import os

import pytest

import check_queries
from sievegrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    state, _, _, _, note = check_queries.compare(
        spark, check_queries.connect(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name]
    )
    assert state == "ok", note


def test_every_number_has_its_query():
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in queries.QUERIES) == 1
    assert "pipeline" in queries.QUERIES
