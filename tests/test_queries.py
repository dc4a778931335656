"""Every registered query of the tender operators against its SQL, or for rows."""

import pytest

from tendermill import registry

from .compare import duck, same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.limit(1).count() == 1


def test_names_are_known():
    assert set(ORACLES) <= set(QUERIES)
