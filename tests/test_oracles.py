"""Every registered query against its SQL statement on the same Parquet files."""

import pytest
from compare import compare, duck

from noticeworks.plans import catalog


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, small_dir, name):
    good, note = compare(
        spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), small_dir
    )
    assert good, note


def test_every_statement_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
