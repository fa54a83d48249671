"""Every named query of the core against its SQL."""

import pytest
from compare import connect, duck_rows, spark_rows

from cairn.plans.queries import QUERIES
from cairn.plans.sql import ORACLE


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, folder, con, name):
    names, got = spark_rows(QUERIES[name](spark, folder))
    wanted_names, wanted = duck_rows(con, ORACLE[name])
    assert names == wanted_names
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
