import json
import time
from datetime import datetime

import pytest

from cairn.api import Store, within
from cairn.goal_store import Goals, dispatcher
from cairn.operators.embedding import hashed_words
from cairn.sources.store import Sequence


def test_goals(spark, tmp_path):
    g = Goals(spark, str(tmp_path / "goals"))
    a = g.create("Test Goal", "- [x] a\n- [ ] b\n- [x] c", [" bug", "bug", ""], 99, "2026-12-31")
    first = g.get(a).first()
    assert (first["status"], first["progress"], first["labels"], first["priority"]) == ("active", 66, ["bug"], 10) and a.startswith("goal/")
    g.update(a, status="completed", description="- [x] a\n- [ ] b\n- [x] c\n- [ ] d")
    now = g.get(a).first()
    assert (now["status"], now["progress"], now["title"]) == ("completed", 50, "Test Goal")
    b = g.create("Other")
    assert [r["id"] for r in g.list("active").collect()] == [b] and [r["id"] for r in g.list("", ["BUG"]).collect()] == [a]
    g.delete(a)
    with pytest.raises(KeyError):
        g.delete(a)
    with pytest.raises(ValueError):
        g.create("")


def test_dispatch(spark, tmp_path):
    from cairn.streaming import events as st

    log = spark.createDataFrame([(1, "save", "k", "did it", "", datetime(2026, 5, 1)), (2, "save", "k2", "again", "", datetime(2026, 5, 2))], st.EVENT)
    model = lambda prompts: ['Sure: [{"type":"note","title":"t","content":"c","priority":1}]' for _ in prompts]
    run = dispatcher(Store(spark, str(tmp_path / "kv"), hashed_words), Goals(spark, str(tmp_path / "goals")), lambda: log, model)
    key = run({"call": "save_note", "content": '{"content":"remember the milk","tags":["shop"]}'})
    other = run({"call": "save_note", "content": "call the plumber", "labels": "house, urgent"})
    assert [r["key"] for r in run({"call": "search", "query": "the milk"}).collect()][0] == key
    assert [r["key"] for r in run({"call": "find", "query": "PLUMBER"}).collect()] == [other]
    assert json.loads(run({"call": "get_memory", "key": other}))["tags"] == ["house", "urgent"]
    ident = run({"call": "create_goal", "title": "t", "content": "- [x] a\n- [ ] b"})
    assert run({"call": "get_goal", "goal_id": ident}).first()["progress"] == 50
    assert run({"call": "update_goal", "goal_id": ident, "priority": 1}) == "updated"
    assert [r["priority"] for r in run({"call": "list_goals"}).collect()] == [1]
    assert [r["id"] for r in run({"call": "get_timeline", "limit": 1}).collect()] == [2]
    text = run({"call": "get_context", "query": "milk"}).first()["text"]
    assert "remember the milk (score: " in text and "Tags: shop" in text and "1. t [50%] priority=1" in text
    assert [r["title"] for r in run({"call": "suggest", "query": "now"}).collect()] == ["t"]
    assert [r["content"] for r in run({"call": "extract", "text": "something"}).collect()] == ["c"]
    assert run({"call": "delete_memory", "key": key}) == "deleted" and run({"call": "get_memory", "key": key}).startswith("not found")
    assert key not in [r["key"] for r in run({"call": "search", "query": "the milk"}).collect()]
    assert run({"call": "answer", "answer": "hi"}) == "hi" and run({"answer": "hi"}) == "hi" and run({"call": "dance"}) == "unknown command: dance"
    assert run({"call": "get_goal"}) == "failed: no goal id given" and run({"call": "delete_goal", "goal_id": "x"}) == "not found: x"


def test_every_call_of_the_commands_is_known(spark, folder, tmp_path):
    from cairn.sources.tables import table

    run = dispatcher(Store(spark, str(tmp_path / "kv")), Goals(spark, str(tmp_path / "goals")))
    for (call,) in table(spark, folder, "agent_commands").select("call").distinct().collect():
        assert not str(run({"call": call})).startswith("unknown command")


def test_numbers_of_two_writers_differ():
    a, b = Sequence(1), Sequence(2)
    made = [n for _ in range(1000) for n in (a.next(), b.next(3))]
    assert len(set(made)) == 2000 and made[::2] == sorted(made[::2])


def test_two_stores_on_one_folder(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "kv")), Store(spark, str(tmp_path / "kv"))
    a.save("k", '{"content":"one"}'), b.save("k", '{"content":"two"}'), a.save("j", '{"content":"three"}')
    assert json.loads(a.get("k"))["content"] == "two" and a.log.read().select("seq").distinct().count() == 3
    assert json.loads(a.get("k"))["timestamp"].startswith("20")


def test_a_save_that_takes_too_long(spark):
    with pytest.raises(TimeoutError):
        within(spark, 0.2, lambda: time.sleep(2))
    assert within(spark, 5, lambda: 7) == 7
    with pytest.raises(ZeroDivisionError):
        within(spark, 5, lambda: 1 / 0)


def test_json_hits(spark, tmp_path):
    s = Store(spark, str(tmp_path / "kv"), hashed_words)
    s.save("a", '{"content":"green tea"}'), s.save("b", '{"content":"black coffee"}')
    hits = [json.loads(r["json"]) for r in s.search_json("tea", 1).collect()]
    assert hits[0]["key"] == "a" and json.loads(hits[0]["value"])["content"] == "green tea"
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "kv")).search("tea")
