"""Every registered query of the core against its SQL, on whole tables."""

import pytest
from compare import assert_same

from lodestar.plans import core, retrieval

QUERIES = core.QUERIES | retrieval.QUERIES
SQL = core.ORACLES | retrieval.ORACLES


def test_every_query_has_its_sql():
    assert SQL.keys() == QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])
