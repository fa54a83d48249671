"""The event timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import cut


def between(events: DataFrame, start: str = "", end: str = "", limit: int = 50) -> DataFrame:
    """The newest events from `start` to `end`, both included ('' for open), 50 for a limit of 0 or less. A date alone is its midnight."""
    out = events
    if start:
        out = out.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("created_at") <= F.lit(end).cast("timestamp"))
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit if limit > 0 else 50)


def as_values(events: DataFrame) -> DataFrame:
    """Events in the form of values: the summary as content, the type as summary."""
    return events.select("id", "key", F.col("summary").alias("content"), F.col("event_type").alias("summary"), "created_at")


def lines(events: DataFrame) -> DataFrame:
    """[day] key: beginning of the content."""
    text = F.concat(F.lit("["), F.date_format("created_at", "yyyy-MM-dd"), F.lit("] "), F.coalesce("key", F.lit("")), F.lit(": "), cut(F.coalesce("content", F.lit("")), 80))
    return events.select("id", text.alias("line"))


def call_event(tool: Column, key: Column, project: Column, query: Column, ident: Column, summary: Column, text: Column) -> Column:
    """The event of a tool call: its key is the first of key, project, query and id that is not empty, its summary the given one or the text's beginning."""
    empty = F.lit("")
    first = F.coalesce(*[F.nullif(c, empty) for c in (key, project, query, ident)], empty)
    return F.struct(tool.alias("event_type"), first.alias("key"), F.coalesce(F.nullif(summary, empty), cut(F.coalesce(text, empty), 80)).alias("summary"))


def digest(events: DataFrame, active_goals: DataFrame, limit: int = 20, items: int = 5) -> DataFrame:
    """One row about the newest `limit` events: how many they are (events, and notes, one for each), how many active goals there are, and the first `items` notes (summary, else content, else key)."""
    page = events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    note = F.coalesce(F.nullif("summary", F.lit("")), F.nullif("content", F.lit("")), F.col("key"), F.lit(""))
    one = F.struct((-F.unix_micros("created_at")).alias("t"), (-F.col("id")).alias("i"), note.alias("x"))
    first = F.transform(F.slice(F.array_sort(F.collect_list(one)), 1, items), lambda s: s["x"])
    counted = page.agg(F.count("*").alias("events"), F.count("*").alias("notes"), F.array_join(first, " | ").alias("first_items"))
    return counted.crossJoin(active_goals.agg(F.count("*").alias("goals"))).select("events", "notes", "goals", "first_items")
