import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from filegrove.llm import queries
from oracle import both, database

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    got, want = both(spark, database(SMALL), queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert got[0] == want[0]
    assert got[1] == want[1] and got[1]
