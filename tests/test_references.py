from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.operators.references import broken_references, normal_goal_ref
from cairn.operators.skew import salted_lookup

T = [datetime(2026, 1, d) for d in range(1, 10)]
REFS = "row int, a string, b string, at timestamp, first_at string, count string"
KEYS = "a string, b string, at timestamp, deleted boolean, kind string"


@pytest.fixture(scope="module")
def tables(spark):
    refs = [(1, "x", "1", T[5]), (2, "x", None, T[5]), (3, None, "9", T[5]), (4, None, None, T[5]), (5, "y", "2", T[1]), (6, "z", "3", T[5]), (7, "q", "1", T[5]), (7, "q", "1", T[5]), (8, "x", "1", None)]
    keys = [("x", "1", T[2], False, ""), ("y", "2", T[3], None, ""), ("z", "3", T[1], False, ""), ("z", "3", T[4], True, ""), ("z", "3", T[6], False, ""), (None, "1", T[1], False, "")]
    return spark.createDataFrame([(*r, "", "") for r in refs], REFS), spark.createDataFrame(keys, KEYS)


def found(refs, keys, match):
    return sorted(tuple(r) for r in broken_references(refs, keys, ["a", "b"], ["a", "b"], "row", "at", "at", "deleted", match).collect())


def test_match_semantics(tables):
    base = [(5, "late"), (6, "deleted"), (7, "missing"), (7, "missing")]
    assert found(*tables, "simple") == base
    assert found(*tables, "partial") == sorted([*base, (3, "missing")])
    assert found(*tables, "full") == sorted([*base, (2, "missing"), (3, "missing")])
    with pytest.raises(ValueError):
        found(*tables, "other")


def test_empty_tables(tables):
    refs, keys = tables
    assert found(refs.limit(0), keys, "partial") == []
    assert {k for _, k in found(refs, keys.limit(0), "simple")} == {"missing"}


def test_normal_forms(spark):
    forms = [" goal/1 ", "GOAL/1", "goal/1/", "memory/goals/active/goal/1", "\tmemory/goals/done/GOAL/1/ ", "", "  ", None]
    got = spark.createDataFrame([(f,) for f in forms], "x string").select(normal_goal_ref(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == ["goal/1"] * 5 + [None] * 3


def test_hot_keys_join_like_any(spark):
    facts = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("7", 2)], "k string, v int")
    got = salted_lookup(facts, dim, "k", F.col("id"))
    assert got.count() == 5000
    assert got.where("v = 1").count() == facts.where("k = 'hot'").count() and got.where("v = 2").count() == 1
