import pytest
from compare import connect, duck_rows, spark_rows

from cairn.llm.queries import QUERIES
from cairn.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, folder, name):
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(connect(folder), ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, folder, name):
    rows = QUERIES[name](spark, folder)
    n = rows.count()
    assert n > 0
    if name.endswith("_found"):
        assert rows.distinct().count() == n
