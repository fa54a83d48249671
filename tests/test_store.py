from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cairn.api import Store, value_of
from cairn.operators import goals, graph, sessions
from cairn.sources import store


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"))
    assert s.save("memory/test/a", '{"content":"Hello world","tags":["t"]}') == "memory/test/a"
    s.save("memory/test/sub/b", '{"wife":"Эка","city":"Москва"}')
    made = s.save("", '{"content":"x"}', at=datetime(2026, 1, 2, tzinfo=timezone.utc))
    assert made.startswith("memory/auto/2026-01-02/") and len(made.split("/")) == 4 and len(made.split("/")[3]) == 8
    assert s.save("k", '{"content":"x"}', auto_key=True, at=datetime(2026, 1, 2, tzinfo=timezone.utc)) == made
    assert "Эка" in s.get("memory/test/sub/b")
    s.save("memory/test/a", '{"content":"again"}')
    assert "again" in s.get("memory/test/a")
    assert [r["entry"] for r in s.list("memory/test/").collect()] == ["memory/test/a", "memory/test/sub/"]
    assert [r["entry"] for r in s.list("none/").collect()] == []
    s.delete("memory/test/a")
    s.delete("memory/test/a")
    with pytest.raises(KeyError):
        s.get("memory/test/a")
    with pytest.raises(ValueError):
        s.save("x", "not valid json")
    with pytest.raises(ValueError):
        s.find("")
    s.add_edge("A/1", "B", "knows", "2026-01-01")
    assert [tuple(r) for r in s.neighbours("A/1").collect()] == [("B", "knows", "out")]
    s.save_session("foo/bar", '{"task":"t"}')
    assert s.session("foo/bar") == '{"task":"t"}'
    small = s.log.compact(str(tmp_path / "small"))
    assert small.read().count() == s.values().count()
    assert sorted(r["key"] for r in store.current(small.read()).collect()) == sorted(r["key"] for r in s.values().collect())


def test_value_of():
    assert value_of('{"summary":"s"}') == '{"summary": "s"}'
    assert value_of("[1]") == '{"content": "[1]"}'


def test_batch_keeps_order_and_repeats(spark):
    kv = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    keys = spark.createDataFrame([(0, "b"), (1, "x"), (2, "b"), (3, ""), (4, None)], "pos int, key string")
    assert [tuple(r) for r in store.get_batch(kv, keys).collect()] == [(0, "b", "2", True), (1, "x", None, False), (2, "b", "2", True)]


def test_goals(spark):
    at = datetime(2026, 1, 1)
    g = spark.createDataFrame([("g1", "t", "d", "active", ["a"], 5, 10, "", at, at), ("g2", "u", None, "active", [], 9, 0, None, at, at)], goals.GOAL)
    p = spark.createDataFrame([("g1", "", "- [x] a\n- [ ] b", "", None, -1, -1, "soon", at), ("none", "x", "", "", None, 1, 1, "", at)], "id string, title string, description string, status string, labels array<string>, priority int, progress int, deadline string, at timestamp")
    new = {r["id"]: r for r in goals.updated(g, p).collect()}
    assert len(new) == 2 and (new["g1"]["progress"], new["g1"]["title"], new["g1"]["deadline"], new["g1"]["labels"]) == (50, "t", "soon", ["a"])
    assert [r["id"] for r in goals.listed(g, "active").collect()] == ["g2", "g1"]
    assert goals.mirror(g).where("key like 'memory/goals/active/%'").count() == 2
    assert goals.without(g, g.where("id = 'g1'")).count() == 1


def test_sessions_keep_what_is_exactly_old(spark):
    now = datetime(2026, 1, 10)
    rows = spark.createDataFrame([("session/project/p/x", now - timedelta(days=7)), ("session/project/p/y", now - timedelta(days=7, seconds=1)), ("session/project/p/latest", now - timedelta(days=99))], "key string, created_at timestamp")
    assert [r["key"] for r in sessions.expired(rows, now, timedelta(0)).collect()] == ["session/project/p/y"]


def test_graph_skips_what_is_no_edge(spark):
    kv = spark.createDataFrame([("memory/graph/1", '{"from":"A","to":"B","relation":"r"}'), ("memory/graph/2", "[]"), ("memory/graph/3", "bad"), ("memory/graph/d/", '{"from":"A","to":"C"}')], "key string, value string")
    e = graph.read(kv)
    assert [(r["src"], r["dst"]) for r in e.collect()] == [("A", "B")]
    assert {tuple(r) for r in graph.reach(e, "B", 3).select("entity", F.col("hops")).collect()} == {("B", 0), ("A", 1)}
