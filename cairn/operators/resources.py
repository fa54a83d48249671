"""Ready-made views of a store: what a caller reads without asking a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.render import goal_line
from cairn.operators import goals as goal_ops
from cairn.operators import models
from cairn.operators import timeline as timeline_ops


def numbered(rows: DataFrame, order: list, section: str, line) -> DataFrame:
    """section, position, line of rows whose number an operator before has limited."""
    k = F.row_number().over(Window.orderBy(*order))
    return rows.select(F.lit(section).alias("section"), k.alias("position"), line.alias("line"))


def goal_view(goals: DataFrame) -> DataFrame:
    rows = goal_ops.listed(goals, "active")
    return numbered(rows, [F.desc("priority"), F.desc("created_at"), F.col("id")], "goals", goal_line(F.col("id"), F.col("title"), F.col("status"), F.col("priority"), F.col("progress")))


def timeline_view(events: DataFrame, limit: int = 10) -> DataFrame:
    rows = timeline_ops.as_values(timeline_ops.between(events, limit=limit))
    lines = timeline_ops.lines(rows).join(rows.select("id", "created_at"), "id")
    return numbered(lines, [F.desc("created_at"), F.desc("id")], "timeline", F.col("line"))


def insights(goals: DataFrame, events: DataFrame, model: models.Model) -> DataFrame:
    """section, position, line: what a model notices in the active goals and the newest events, as JSON objects; five at most."""
    found = models.suggest(goals, events, model, "recent patterns and insights", 5)
    line = F.to_json(F.struct("type", "title", "description", "priority"))
    return found.select(F.lit("insights").alias("section"), (F.col("position") + 1).alias("position"), line.alias("line"))


def awareness(goals: DataFrame, events: DataFrame, context_text: DataFrame) -> DataFrame:
    """One row, text: a question's context (one row, text), the active goals and the five newest events; a plain sentence where there is nothing."""
    none = F.lit("")
    g = goal_ops.listed(goals, "active").withColumn("k", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("created_at"), "id")))
    goal = F.concat(F.lit("- ["), F.coalesce("progress", F.lit(0)).cast("string"), F.lit("%] "), F.coalesce("title", none), F.lit(": "), F.coalesce("description", none))
    e = timeline_ops.as_values(timeline_ops.between(events, limit=5))
    line = timeline_ops.lines(e).join(e.select("id", "created_at"), "id").withColumn("k", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))))

    def part(rows: DataFrame, head: str, name: str) -> DataFrame:
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: F.concat(s["x"], F.lit("\n"))), "")
        return rows.agg(F.when(F.count("*") > 0, F.concat(F.lit(f"\n\n## {head}\n"), body)).otherwise("").alias(name))

    all_ = context_text.crossJoin(part(g.select("k", goal.alias("x")), "Active Goals", "g")).crossJoin(part(line.select("k", F.concat(F.lit("- "), "line").alias("x")), "Recent Activity", "e"))
    whole = F.concat(F.coalesce("text", none), "g", "e")
    return all_.select(F.when(whole == "", "Nothing is known yet.").otherwise(whole).alias("text"))


def snapshot(goals: DataFrame, events: DataFrame, context_text: DataFrame) -> DataFrame:
    """name, text of the views that a caller reads at once: the context, the active goals and the ten newest events, the latter two as JSON lines."""
    g = goal_ops.listed(goals, "active").select(F.struct((-F.col("priority")).alias("a"), (-F.unix_micros("created_at")).alias("b"), F.col("id").alias("c"), F.to_json(F.struct("id", "title", "status", "labels", "priority", "progress", "deadline")).alias("x")).alias("s"))
    e = timeline_ops.as_values(timeline_ops.between(events, limit=10)).select(F.struct((-F.unix_micros("created_at")).alias("a"), (-F.col("id")).alias("b"), F.lit("").alias("c"), F.to_json(F.struct("id", "key", "content", "summary")).alias("x")).alias("s"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n")
    named = lambda rows, name: rows.select(F.lit(name).alias("name"), "text")
    return reduce(DataFrame.unionByName, [named(context_text, "context"), named(g.agg(lines.alias("text")), "goals"), named(e.agg(lines.alias("text")), "timeline")])
