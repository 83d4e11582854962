"""Every query with an oracle on the smallest scale. Queries without one are tested elsewhere: fits in test_registered.py and test_fitted.py, op queries in llm/."""

from __future__ import annotations

import pytest
from compare import compare, oracle

import __spark_entry__ as entry
from ridegauge import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    ok, message = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, message
