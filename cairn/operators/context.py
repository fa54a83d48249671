"""Context for a question: similar memories, active goals, reminders; as rows and as text."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import goals as goal_ops
from cairn.operators.search import search

#: Headings of the sections.
HEADS = {1: "=== Relevant memories ===", 2: "\n=== Active goals ===", 3: "\n=== Upcoming reminders ==="}


def memories(embeddings: DataFrame, values: DataFrame, query: Sequence[float], limit: int = 5) -> DataFrame:
    """rank, key, score and the columns of `values` (key, content, summary, created_at, tags, goal_id) of the best hits; hits without a value are dropped, ranks are those before that."""
    hits = search(embeddings, query, limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")))
    return hits.join(values, "key").select("rank", "key", "score", *[c for c in values.columns if c != "key"])


def counts(embeddings: DataFrame, values: DataFrame, goals: DataFrame, query: Sequence[float], limit: int = 5) -> DataFrame:
    """One row: total_count (hits, with or without a value), memories (hits with one) and active goals of a question's context."""
    hits = search(embeddings, query, limit).select("key").join(values.select("key", F.lit(1).alias("kept")), "key", "left")
    both = hits.agg(F.count("*").alias("total_count"), F.count("kept").alias("memories"))
    return both.crossJoin(goal_ops.listed(goals, "active").agg(F.count("*").alias("goals")))


def reminders(kv: DataFrame, now: datetime, prefix: str = "memory/reminder/") -> DataFrame:
    """key, value of reminders: those of a day more than 24 hours before `now` are left out, those without a day in their key stay."""
    part = F.split("key", "/")
    day = F.when(F.size(part) >= 4, F.try_to_timestamp(F.when(part[2].rlike(r"^\d{4}-\d{2}-\d{2}$"), part[2]), F.lit("yyyy-MM-dd")))
    return kv.where(F.col("key").startswith(prefix) & ~F.col("key").endswith("/")).where(day.isNull() | (day >= F.lit(now - timedelta(hours=24)))).select("key", "value")


def _more(label: str, value: Column) -> Column:
    """A further line of an entry, or nothing for an empty value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"\n   {label}"), value)).otherwise("")


def lines(found: DataFrame, goals: DataFrame, notes: DataFrame) -> DataFrame:
    """section, position, line of the text that is put before a question. Reminders show only if there are memories or goals.

    found: as memories() gives it; an entry has further lines for its summary, tags and goal, an active goal one for its description. Missing texts are empty.
    """
    none = F.lit("")
    entry = F.concat(
        F.lit(". ["), F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), none), F.lit("] "), F.coalesce("content", none), F.lit(" (score: "), F.format_string("%.2f", F.col("score")), F.lit(")"),
        _more("Summary: ", F.col("summary")), _more("Tags: ", F.array_join("tags", ", ")), _more("Goal: ", F.col("goal_id")),
    )
    m = found.withColumn("k", F.row_number().over(Window.orderBy("rank")))
    m = m.select(F.lit(1).alias("section"), F.col("k").cast("bigint").alias("position"), F.concat(F.col("k").cast("string"), entry).alias("line"))
    g = goal_ops.listed(goals, "active").withColumn("k", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("created_at"), "id")))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    shown = F.concat(
        F.col("k").cast("string"), F.lit(". "), F.coalesce("title", none), F.lit(" ["), number("progress"), F.lit("%] priority="), number("priority"), F.lit(" deadline="), F.coalesce("deadline", none), _more("", F.col("description"))
    )
    g = g.select(F.lit(2).alias("section"), F.col("k").cast("bigint").alias("position"), shown.alias("line"))
    some = m.select("section").limit(1).unionByName(g.select("section").limit(1)).agg((F.count("*") > 0).alias("some"))
    r = notes.crossJoin(F.broadcast(some)).where("some").select(F.lit(3).alias("section"), F.lit(0).cast("bigint").alias("position"), F.concat(F.lit("- ["), "key", F.lit("] "), F.coalesce("value", none)).alias("line"))
    return m.unionByName(g).unionByName(r)


def text(rows: DataFrame, now: datetime) -> DataFrame:
    """One row, text: the sections under their headings, after the time; '' without rows. Memories and goals are limited by the operators that made them; a prompt
    holds all reminders from yesterday on, which a prompt must be able to hold: those of a store for people, not of a corpus."""
    head = F.element_at(F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv]), F.col("section"))
    per = rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]), "\n").alias("body"))
    body = per.select("section", F.concat(head, F.lit("\n"), "body").alias("body"))
    return body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: s["body"]), "\n").alias("text")).select(F.when(F.col("text") != "", F.concat(F.lit(now.strftime("%Y-%m-%d %H:%M:%S") + "\n"), "text")).otherwise("").alias("text"))
