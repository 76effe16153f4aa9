"""Queries of the subpackage against their SQL on the same files."""

import pytest
from compare import compare, duck

from noticeworks.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, small_dir, name):
    good, note = compare(spark, duck(small_dir), name, queries.QUERIES[name], queries.ORACLES[name], small_dir)
    assert good, note
