"""Every query against its SQL on DuckDB."""

import pytest
from conftest import SF
from oracle import compare, connect

from tracegrain.plans.queries import ORACLES, QUERIES

NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    rows = QUERIES[name](spark, SF)
    assert compare(rows, con, ORACLES[name]) == ""
    assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 0, "nothing compared with nothing"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(ORACLES) <= set(e.queries())


def test_every_query_has_sql():
    assert not set(QUERIES) - set(ORACLES)
