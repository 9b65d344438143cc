"""Every query of the library against its SQL, over the smallest tables."""

import pytest

from skein.plans import registry
from tests import compare


@pytest.fixture(scope="module")
def db(data):
    return compare.database(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_agree(spark, data, db, name):
    assert compare.differ(registry.QUERIES[name](spark, data), db, registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs_without_sql(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
