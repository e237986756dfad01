"""Queries of files, scenes and learning agree with their SQL twins on the smallest tables."""

import pytest

from pointspark.plans import files, learning, scenes
from tests.compare import duck, rows
from tests.conftest import SMALL

QUERIES = {**files.queries(), **scenes.queries(), **learning.queries()}
SQL = {**files.oracle_sql(), **scenes.oracle_sql(), **learning.oracle_sql()}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, con, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
