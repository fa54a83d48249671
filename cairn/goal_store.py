"""Goals in a folder of versions, and commands that are dispatched to a store and its goals."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.api import Store
from cairn.functions import text
from cairn.operators import goals as ops
from cairn.operators import dig, models, timeline
from cairn.operators.models import Model
from cairn.session import file_system
from cairn.sources.store import Sequence

VERSION = f"{ops.GOAL}, seq bigint, deleted boolean"
PATCH = "id string, title string, description string, status string, labels array<string>, priority int, progress int, deadline string, at timestamp"


class Goals:
    """An append-only log of goal versions; the last version of an id holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.numbers = spark, path, Sequence()

    def _log(self) -> DataFrame:
        fs, p = file_system(self.spark, self.path)
        return self.spark.read.schema(VERSION).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], VERSION)

    def _append(self, goals: DataFrame, deleted: bool = False) -> None:
        goals.withColumns({"seq": F.lit(self.numbers.next()).cast("bigint"), "deleted": F.lit(deleted)}).write.mode("append").parquet(self.path)

    def current(self) -> DataFrame:
        fields = [f.strip().split(" ")[0] for f in ops.GOAL.replace("array<string>", "a").split(",")]
        last = F.max_by(F.struct(*fields[1:], "deleted"), "seq").alias("g")
        return self._log().groupBy("id").agg(last).where(~F.col("g.deleted")).select("id", *[f"g.{c}" for c in fields[1:]])

    def create(self, title: str, description: str = "", labels: list[str] | None = None, priority: int = 5, deadline: str = "", at: datetime | None = None) -> str:
        """A new goal, active, its priority between 0 and 10; gives its id."""
        if not title:
            raise ValueError("a title is needed")
        now = at or datetime.now(timezone.utc)
        ident = f"goal/{now:%Y-%m-%d}/{int(now.timestamp() * 1_000_000) * 1000}"
        row = self.spark.createDataFrame([(ident, title, description, labels or [], max(0, min(10, priority)), deadline, now)], "id string, title string, description string, labels array<string>, priority int, deadline string, created_at timestamp")
        self._append(ops.created(row))
        return ident

    def get(self, ident: str) -> DataFrame:
        """The goal as one row; KeyError if there is none."""
        found = ops.get(self.current(), ident)
        if found.isEmpty():
            raise KeyError(ident)
        return found

    def update(self, ident: str, **changes: object) -> None:
        """Change fields of a goal; texts that are empty and numbers below 0 leave a field as it is."""
        now = changes.pop("at", None) or datetime.now(timezone.utc)
        patch = {"title": "", "description": "", "status": "", "labels": None, "priority": -1, "progress": -1, "deadline": ""} | changes
        row = self.spark.createDataFrame([(ident, *(patch[k] for k in ("title", "description", "status", "labels", "priority", "progress", "deadline")), now)], PATCH)
        self._append(ops.updated(self.get(ident), row))

    def delete(self, ident: str) -> None:
        self._append(self.get(ident), deleted=True)

    def list(self, status: str = "", labels: list[str] | None = None) -> DataFrame:
        return ops.listed(self.current(), status, labels)


def dispatcher(store: Store, goals: Goals, events: Callable[[], DataFrame] | None = None, model: Model | None = None) -> Callable[[dict], DataFrame | str]:
    """A function that carries out commands (call and its arguments). Unknown calls, and calls without what they need, give a message, not an error.

    events: gives the event log (streaming.events.EVENT); model: answers prompts. A missing key or goal is a message too.
    """

    def need(c: dict, name: str, what: str) -> str:
        if not c.get(name):
            raise ValueError(f"no {what} given")
        return c[name]

    def log() -> DataFrame:
        if events is None:
            raise ValueError("there is no event log")
        return events()

    def asked() -> Model:
        if model is None:
            raise ValueError("there is no model")
        return model

    def limit(c: dict, otherwise: int) -> int:
        n = c.get("limit") or c.get("row_limit") or 0
        return n if n > 0 else otherwise

    def labels(c: dict) -> list[str] | None:
        raw = c.get("labels")
        if raw is None or isinstance(raw, list):
            return raw
        return store.spark.range(1).select(text.loose_labels(F.lit(raw)).alias("l")).first()["l"]

    def note(c: dict) -> str:
        body = c.get("content") or c.get("text") or ""
        try:
            json.loads(body)
        except ValueError:
            body = json.dumps({"content": body, "summary": c.get("title") or body.split("\n", 1)[0], "tags": labels(c) or []}, ensure_ascii=False)
        return store.save(c.get("key") or "", body, auto_key=not c.get("key"))

    def found(c: dict) -> DataFrame:
        query = need(c, "query", "query")
        return store.search(query, limit(c, 10)) if store.embed else store.find(query, limit(c, 20))

    def extract(c: dict) -> DataFrame:
        rows = store.spark.createDataFrame([("1", c.get("text") or c.get("content") or "")], "id string, text string")
        return models.extract_facts(rows, asked())

    def dug(c: dict) -> DataFrame:
        given = dig.arguments(c.get("text") or "") if not c.get("query") else {"query": c["query"], "keywords": c.get("keywords") or [], "window": c.get("window") or "", "limit": limit(c, 10)}
        return store.dig(given["query"], given["keywords"], given["window"], given["limit"])

    calls: dict[str, Callable[[dict], DataFrame | str]] = {
        "": lambda c: c.get("answer") or "",
        "answer": lambda c: c.get("answer") or "",
        "search": found,
        "find": lambda c: store.find(need(c, "query", "query"), limit(c, 20)),
        "get_memory": lambda c: store.get(need(c, "key", "key")),
        "memory_get": lambda c: store.get(need(c, "key", "key")),
        "save_note": note,
        "delete_memory": lambda c: store.delete(need(c, "key", "key")) or "deleted",
        "delete": lambda c: store.delete(need(c, "key", "key")) or "deleted",
        "create_goal": lambda c: goals.create(c.get("title") or "", c.get("content") or c.get("description") or "", labels(c), c.get("priority", 5), c.get("deadline") or ""),
        "get_goal": lambda c: goals.get(need(c, "goal_id", "goal id")),
        "update_goal": lambda c: goals.update(need(c, "goal_id", "goal id"), **{k: c[k] for k in ("title", "description", "status", "priority", "progress", "deadline") if c.get(k) is not None} | ({"labels": labels(c)} if c.get("labels") else {})) or "updated",
        "delete_goal": lambda c: goals.delete(need(c, "goal_id", "goal id")) or "deleted",
        "list_goals": lambda c: goals.list(c.get("status") or "active", labels(c)),
        "get_timeline": lambda c: timeline.between(log(), c.get("from") or c.get("time_from") or "", c.get("to") or c.get("time_to") or "", limit(c, 10)),
        "get_context": lambda c: store.context(c.get("query") or "", goals.current(), limit(c, 5)),
        "suggest": lambda c: models.suggest(goals.current(), log(), asked(), c.get("query") or "", limit(c, 5), c.get("lang") or "en"),
        "extract": extract,
        "dig": dug,
        "session_get": lambda c: store.session(c.get("project") or ""),
        "list": lambda c: store.list(c.get("prefix") or ""),
    }

    def run(command: dict) -> DataFrame | str:
        call = calls.get(command.get("call") or "")
        if not call:
            return f"unknown command: {command.get('call')}"
        try:
            return call(command)
        except KeyError as e:
            return f"not found: {e.args[0]}"
        except ValueError as e:
            return f"failed: {e}"

    return run
