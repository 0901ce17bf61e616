"""Every registered query against its SQL twin; those without one run and have a stable schema."""

import pytest
from compare import differences, duck

from sparkloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_without_sql(spark, name):
    first, second = (queries.QUERIES[name](spark, SF) for _ in range(2))
    assert first.schema == second.schema and first.count() == second.count() > 0
