import pytest

from filegrove.plans import catalogue
from oracle import both, database

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_agrees_with_its_sql(spark, db, name):
    got, want = both(spark, db, catalogue.QUERIES[name], catalogue.ORACLES[name], SMALL)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "no rows: agreement says nothing"
