import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from cairn.__main__ import arguments, main
from cairn.functions import render
from cairn.operators import models
from cairn.operators.http_model import HttpModel, body, reply
from cairn.operators.search import cosine, nearest, search


@pytest.fixture()
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = asked["messages"][-1]["content"]
            out = {"error": "no"} if "bad" in text else {"message": {"content": text.upper()}} if self.path == "/api/chat" else {"choices": [{"message": {"content": text[::-1]}}]}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_model(server, spark):
    assert HttpModel(server, "m")(["abc"]) == ["ABC"]
    assert HttpModel(server + "/v1", "m", "openai")(["abc"]) == ["cba"]
    assert HttpModel(server, "m", pause=0)(["bad"]) == [""]
    assert HttpModel("http://127.0.0.1:9", "m", pause=0, tries=1, timeout=1)(["x"]) == [""]
    assert HttpModel(server, "m", pause=9).asked(["bad"]) == [(None, "refused: no")]
    assert HttpModel("http://127.0.0.1:9", "m", pause=0, tries=2, timeout=1).asked(["x"])[0][1].startswith("not reached")
    told = models.answers(spark.createDataFrame([("1", "bad"), ("2", "abc")], "id string, prompt string"), HttpModel(server, "m", pause=0)).orderBy("id").collect()
    assert [(r["answer"], r["error"]) for r in told] == [(None, "refused: no"), ("ABC", None)]
    rows = spark.createDataFrame([("1", "abc"), ("2", " "), ("3", None)], "id string, prompt string")
    assert [r["answer"] for r in models.answers(rows, HttpModel(server, "m")).orderBy("id").collect()] == ["ABC", None, None]


def test_bodies():
    assert json.loads(body("ollama", "m", "p", "s"))["messages"] == [{"role": "system", "content": "s"}, {"role": "user", "content": "p"}]
    assert reply('{"message":{"content":"hel"}}\n\n{"message":{"content":"lo"}}\n{"done":true}') == "hello"
    for bad in ("garbage", '{"error":{"message":"no"}}', "{}"):
        with pytest.raises(ValueError):
            reply(bad)


def test_terminal(tmp_path, capsys, spark):
    path = str(tmp_path / "s")
    run = lambda *a: (main([path, "--json", "--master", "local[4]", *a]), capsys.readouterr().out)
    assert run("save", "a/b", '{"content":"hello"}') == (0, "a/b\n")
    assert "hello" in run("get", "a/b")[1]
    assert json.loads(run("list", "a/")[1]) == {"entry": "a/b"}
    assert json.loads(run("find", "HELLO")[1])["key"] == "a/b"
    assert json.loads(run("search", "hello world")[1])["key"] == "a/b"
    assert "hello (score: " in run("context", "hello")[1] and run("goals") == (0, "")
    assert run("delete", "a/b")[0] == 0 and run("get", "a/b")[0] == 1
    assert arguments([path, "dig", "x", "--window", "1d"]).window == "1d"


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])]
    df = spark.createDataFrame([(i, str(i), v) for i, v in rows], "id bigint, key string, embedding array<float>")
    assert [r["key"] for r in search(df, [1.0, 0.0], 3).collect()] == ["1", "6", "3"]
    assert df.where("id = 1").select(cosine(F.col("embedding"), [1.0, 0.0, 0.0]).alias("s")).first()["s"] is None
    v = df.select("id", F.col("embedding").alias("vector"))
    got = [(r["query_id"], r["id"], r["rank"]) for r in nearest(v.where("id in (1, 2)"), v, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 6, 2), (2, 2, 1), (2, 3, 2)]
    assert nearest(v.limit(0), v, 2).count() == 0


def test_lines(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(render.percent(F.lit(0.874))) == "87%"
    assert one(render.short(F.lit("abcdefghij"), 8)) == "abcde..."
    assert one(render.goal_line(F.lit("g"), F.lit("t"), F.lit("completed"), F.lit(5), F.lit(50))) == "✓ g" + " " * 23 + " P5 [█████░░░░░]  50% t"
    assert one(render.goal_card(F.lit("<t>"), F.lit(None).cast("string"), F.array(F.lit("a")), F.lit(""), F.lit(3))) == "<b>&#60;t&#62;</b> 3%\n\na"
