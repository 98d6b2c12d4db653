"""Every query of the knowledge store against its SQL twin, over the small tables."""

import pytest

from quillstone.queries import ORACLE, QUERIES
from sql_twin import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, sf, con, name):
    compare(QUERIES[name](spark, sf), con, ORACLE[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
