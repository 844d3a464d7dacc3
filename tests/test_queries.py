"""Every registered query against its SQL twin on the smallest driver tables."""

import pytest

from checks.compare import check, duck
from checks.registry import CHECKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query(spark, con, name):
    run, sql = CHECKS[name]
    rows, problem = check(spark, con, SF, run, sql)
    assert problem is None, problem
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["verdict", "n", "action"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
