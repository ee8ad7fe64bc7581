"""Every query of the core beside its SQL twin on the smallest tables."""

import pytest

from tamarack import io_queries, queries
from tests.helpers import spark_rows, sql_rows

QUERIES = queries.QUERIES | io_queries.QUERIES
ORACLES = queries.ORACLES | io_queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, oracle, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(oracle, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_twin(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
