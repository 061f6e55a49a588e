"""Every registered query of the reference's operators against its SQL."""

import pytest

from rivulet.plans.queries import ORACLES, QUERIES
from tests.compare import duck, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck(ORACLES[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
