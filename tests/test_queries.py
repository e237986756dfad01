"""Every core query that has an SQL twin agrees with it on the smallest tables; the others run."""

import pytest

from pointspark.plans import general, reference
from tests.compare import duck, rows
from tests.conftest import SMALL

QUERIES = {**general.queries(), **reference.queries()}
SQL = {**general.oracle_sql(), **reference.oracle_sql()}


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 52
    assert set(entry.oracle_sql()) <= set(entry.queries())
