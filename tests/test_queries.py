"""Every query of the core against its SQL, and that queries without SQL give rows."""

import pytest
from oracle import SMALL, compare, database

from marlstone.plans import catalog, http, identity, maintenance, manifest, skew

MODULES = (skew, identity, http, catalog, maintenance, manifest)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return database()


def test_names_are_unique():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    compare(spark, con, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
