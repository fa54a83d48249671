"""A store that can be called: the operators behind one object, with the limits that callers may set.

Values are JSON texts with content, summary and tags; a text that is no such object is kept whole as content.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import context, dig, graph, search, sessions
from cairn.operators.embedding import Embedder, embedded
from cairn.session import file_system
from cairn.sources import store

T = TypeVar("T")
VECTOR = "key string, embedding array<float>, seq bigint"


def value_of(raw: str, at: datetime | None = None) -> str:
    """The JSON value of a text: objects with content or summary as they are, all other JSON whole, as content. A value without a timestamp gets the time of saving. Bad JSON raises ValueError."""
    parsed = json.loads(raw)
    value = parsed if isinstance(parsed, dict) and (parsed.get("content") or parsed.get("summary")) else {"content": raw}
    if at is not None and not value.get("timestamp"):
        value = value | {"timestamp": at.strftime("%Y-%m-%dT%H:%M:%SZ")}
    return json.dumps(value, ensure_ascii=False)


def within(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T:
    """What `work` gives; its jobs are cancelled and TimeoutError raised if it takes longer."""
    group, out = uuid.uuid4().hex, {}

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "within", interruptOnCancel=True)
        try:
            out["value"] = work()
        except Exception as e:
            out["error"] = e

    t = InheritableThread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if t.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        raise TimeoutError(f"not done within {seconds} seconds")
    if "error" in out:
        raise out["error"]
    return out["value"]


class Store:
    """A keyed store in a folder: an append-only log, read through its current view.

    With an embedder, saved texts have vectors in a log beside it, which search() looks through; a deleted key loses its vector.
    Several writers may append at once: versions are numbered by time and writer. Many saves are better made as one append of many rows.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Embedder | None = None):
        self.spark, self.log, self.embed, self.numbers = spark, store.VersionLog(spark, path), embed, store.Sequence()
        self.vector_path = f"{path.rstrip('/')}-vectors"

    def values(self) -> DataFrame:
        return store.current(self.log.read())

    def vectors(self) -> DataFrame:
        """key, embedding of the last version of each key that has one."""
        fs, p = file_system(self.spark, self.vector_path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], "key string, embedding array<float>")
        log = self.spark.read.schema(VECTOR).parquet(self.vector_path)
        return log.join(log.groupBy("key").agg(F.max("seq").alias("seq")), ["key", "seq"]).where(F.col("embedding").isNotNull()).select("key", "embedding")

    def _put(self, rows: DataFrame, count: int = 1) -> None:
        """rows: key, value, created_at, n, and text where there is an embedder."""
        seq = self.numbers.next(count)
        self.log.append(store.put(self.spark.createDataFrame([], store.LOG), rows, seq, store.Sequence.WRITERS))
        if self.embed and "text" in rows.columns:
            made = embedded(rows, self.embed)
            rows.select("key").join(made, "key", "left").select("key", "embedding", F.lit(seq).cast("bigint").alias("seq")).write.mode("append").parquet(self.vector_path)

    def save(self, key: str, raw: str, auto_key: bool = False, at: datetime | None = None, timeout: float = 60.0) -> str:
        """Save a JSON text under a key, or under one made of the text; gives the key. A save that takes longer than `timeout` seconds is cancelled: TimeoutError."""
        now = at or datetime.now(timezone.utc)
        value = value_of(raw, now)
        row = self.spark.createDataFrame([(key, raw, value, now, 0)], "key string, text string, value string, created_at timestamp, n int")
        row = store.with_auto_keys(row, F.lit(auto_key))

        def work() -> str:
            made = row.first()["key"]
            self._put(row.withColumn("text", F.coalesce(F.get_json_object("value", "$.content"), F.get_json_object("value", "$.summary"))))
            return made

        return within(self.spark, timeout, work)

    def get(self, key: str) -> str:
        """The value of a key; KeyError if there is none."""
        row = store.get(self.values(), key).first()
        if row is None:
            raise KeyError(key)
        return row["value"]

    def delete(self, key: str) -> None:
        """Delete a key and its vector; one that does not exist is no error."""
        rows, seq = self.spark.createDataFrame([(key, 0)], "key string, n int"), self.numbers.next()
        self.log.append(store.delete(self.spark.createDataFrame([], store.LOG), rows, seq, F.lit(datetime.now(timezone.utc))))
        if self.embed:
            rows.select("key", F.lit(None).cast("array<float>").alias("embedding"), F.lit(seq).cast("bigint").alias("seq")).write.mode("append").parquet(self.vector_path)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """key, score, content of the values most similar to a text; ValueError without an embedder."""
        if not self.embed:
            raise ValueError("a search by meaning needs an embedder")
        content = F.get_json_object("value", "$.content")
        values = self.values().select("key", content.alias("content"), F.get_json_object("value", "$.summary").alias("summary"))
        return search.with_values(search.search(self.vectors(), self.embed([query])[0], limit), values)

    def search_json(self, query: str, limit: int = 10) -> DataFrame:
        """The same hits as JSON, each with its whole value."""
        if not self.embed:
            raise ValueError("a search by meaning needs an embedder")
        return search.as_json(search.search(self.vectors(), self.embed([query])[0], limit), self.values())

    def context(self, query: str, goals: DataFrame, limit: int = 5, now: datetime | None = None) -> DataFrame:
        """One row, text: what is put before a question."""
        if not self.embed:
            raise ValueError("a search by meaning needs an embedder")
        part = lambda name: F.get_json_object("value", f"$.{name}")
        values = self.values().select("key", part("content").alias("content"), part("summary").alias("summary"), F.from_json(part("tags"), "array<string>").alias("tags"), part("goal_id").alias("goal_id"), "created_at")
        at = now or datetime.now(timezone.utc)
        found = context.memories(self.vectors(), values, self.embed([query])[0], limit)
        notes = context.reminders(self.values(), at.replace(tzinfo=None)).withColumn("value", F.coalesce(part("content"), F.col("value")))
        return context.text(context.lines(found, goals, notes), at)

    def list(self, prefix: str = "") -> DataFrame:
        return store.listing(self.values(), prefix).orderBy("entry")

    def find(self, keyword: str, limit: int = 20) -> DataFrame:
        if not keyword:
            raise ValueError("a keyword is needed")
        return search.find(self.values(), keyword, limit)

    def dig(self, query: str, keywords: Sequence[str] = (), window: str = "", most: int = 10) -> DataFrame:
        if not query:
            raise ValueError("a query is needed")
        return dig.scenes(self.values(), query, [k for k in keywords if k], window, search.clamp(most, 10, 50))

    def add_edge(self, src: str, dst: str, relation: str, date: str | None = None) -> None:
        day = date or datetime.now(timezone.utc).strftime("%Y-%m-%d")
        edge = graph.stored(self.spark.createDataFrame([(src, dst, relation, day)], "src string, dst string, relation string, date string"))
        self._put(edge.select("key", "value", "text", F.current_timestamp().alias("created_at"), F.lit(0).alias("n")))

    def neighbours(self, entity: str) -> DataFrame:
        return graph.neighbours(graph.read(self.values()), entity)

    def save_session(self, project: str, data: str, at: datetime | None = None) -> None:
        one = self.spark.createDataFrame([(project, data, at or datetime.now(timezone.utc), 0)], "project string, data string, created_at timestamp, n int")
        self._put(sessions.saved(one))

    def session(self, project: str) -> str:
        return self.get(f"session/project/{project.replace('/', '-')}/latest")


