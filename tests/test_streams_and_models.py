import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.operators import models
from cairn.session import checkpoint_dir
from cairn.sources import store
from cairn.streaming import events as st


def test_event_stream(spark, tmp_path):
    rows = [(i, "save" if i % 2 else "find", "k", "s", "d", datetime(2026, 1, 1 + i // 10, 5)) for i in range(40)]
    st.append_events(spark.createDataFrame(rows, st.EVENT), str(tmp_path / "in"))
    q = st.counts_by_day(st.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("days").agg(F.sum("n")).first()[0] == 40 and spark.table("days").count() == 8


def test_upserts_are_the_same_when_repeated(spark, tmp_path):
    log = store.VersionLog(spark, str(tmp_path / "log"))
    write = st.upsert_into(log)
    batch = spark.createDataFrame([("a", "1", datetime(2026, 1, 1), 0), ("a", "2", datetime(2026, 1, 1), 1)], "key string, value string, created_at timestamp, n int")
    write(batch, 0)
    write(batch, 0)
    assert [(r["key"], r["value"]) for r in store.current(log.read()).collect()] == [("a", "2")]


def _model(prompts):
    return ["no list" if "bad" in p else "Sure: " + json.dumps([{"content": p[-5:], "summary": "s", "tags": ["t"]}]) for p in prompts]


def test_jobs(spark, tmp_path):
    batch = spark.createDataFrame([("1", "hello"), ("2", "bad"), ("3", " ")], "id string, text string")
    run = st.extraction_jobs(_model, str(tmp_path / "facts"), str(tmp_path / "jobs"))
    run(batch, 3)
    run(batch, 3)
    got = {r["id"]: (r["status"], r["facts"]) for r in spark.read.parquet(str(tmp_path / "jobs")).collect()}
    assert got["1"] == ("done", 1) and got["2"] == ("failed", 0)


def test_facts(spark):
    texts = spark.createDataFrame([("1", "hello"), ("2", "bad"), ("3", ""), ("4", None)], "id string, text string")
    assert [(r["id"], r["content"], r["tags"]) for r in models.extract_facts(texts, _model).collect()] == [("1", "hello", ["t"])]


@pytest.mark.parametrize("raw, wanted", [('{"call":"x"}', ("x", None)), ('```json\n{"call":"x"}\n```', ("x", None)), ('so {"call":"x"} it is', ("x", None)), ("plain words", (None, "plain words")), ("{}", None), ("  ", None)])
def test_commands(spark, raw, wanted):
    c = spark.createDataFrame([(raw,)], "x string").select(models.command(F.col("x")).alias("c")).first()["c"]
    assert (c and (c["call"], c["answer"])) == wanted


def test_endpoints():
    assert models.endpoint("http://h:1", "/api/chat") == "http://h:1/api/chat"
    assert models.endpoint("http://h:1/v1", "v1/chat/completions") == "http://h:1/v1/chat/completions"


def test_conversation(spark):
    t = spark.createDataFrame([(1, "hi", "yo"), (2, " ", None)], "id int, said string, answered string")
    assert [(r["id"], r["text"]) for r in models.conversation(t).collect()] == [(1, "User: hi\nAssistant: yo\n")]


def test_checkpoint_folder_is_set_where_none_is(spark):
    assert checkpoint_dir(spark)


def test_a_log_that_cannot_be_written_stops_nothing(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    rows = spark.createDataFrame([(1, "save", "k", "s", "d", datetime(2026, 1, 1))], st.EVENT)
    assert st.append_events(rows, str(tmp_path / "ok")) is None
    assert st.append_events(rows, str(tmp_path / "file" / "in")) is not None


def test_background_writes(spark):
    import threading

    held, done = threading.Event(), []

    def write(rows):
        if rows == "wait":
            held.wait(10)
        if rows == "bad":
            raise ValueError("bad")
        done.append(rows)

    w = st.AsyncWriter(write, depth=2)
    w.submit("wait")
    while not w.waiting.empty():
        pass
    assert w.submit("bad") and w.submit("b") and not w.submit("now")
    held.set()
    w.close()
    assert done == ["now", "wait", "b"] and len(w.errors) == 1


def test_snapshot(spark, folder):
    from cairn.operators import resources
    from cairn.sources import adapters

    text = spark.createDataFrame([("c",)], "text string")
    got = {r["name"]: r["text"] for r in resources.snapshot(adapters.goals(spark, folder), adapters.timeline(spark, folder), text).collect()}
    assert got["context"] == "c" and len(got["timeline"].splitlines()) == 10 and all(json.loads(x)["status"] == "active" for x in got["goals"].splitlines())
    empty = resources.awareness(adapters.goals(spark, folder).limit(0), adapters.timeline(spark, folder).limit(0), spark.createDataFrame([("",)], "text string"))
    assert empty.first()["text"] == "Nothing is known yet."
