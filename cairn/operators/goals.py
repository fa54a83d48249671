"""Goals: lists, changes, their list of subtasks and their mirror among the keyed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import clean_labels, fold_ascii, folded, subtask_marks, subtask_progress

GOAL = "id string, title string, description string, status string, labels array<string>, priority int, progress int, deadline string, created_at timestamp, updated_at timestamp"
MOST = 1000


def ordered(goals: DataFrame) -> DataFrame:
    return goals.orderBy(F.desc("priority"), F.desc("created_at"), "id")


def listed(goals: DataFrame, status: str = "", labels: list[str] | None = None) -> DataFrame:
    """Goals of a status ('' for any) with all of the labels (A to Z in any case), by priority, then newest first; 1000 at most."""
    out = goals if status == "" else goals.where(F.col("status") == status)
    for label in labels or []:
        wanted = F.lit(folded(label))
        out = out.where(F.array_contains(F.transform("labels", fold_ascii), wanted))
    return ordered(out).limit(MOST)


def get(goals: DataFrame, goal_id: str) -> DataFrame:
    return goals.where(F.col("id") == goal_id)


def shown(goals: DataFrame, prefix: str) -> DataFrame:
    """The first goal in the list's order whose id is, or starts with, the prefix."""
    return ordered(goals.where(F.col("id").startswith(prefix))).limit(1)


def created(requests: DataFrame) -> DataFrame:
    """New goals of requests (id, title, description, labels, priority, deadline, created_at): active, labels cleaned, progress from subtasks."""
    return requests.where(F.col("title") != "").select(
        "id", "title", F.coalesce("description", F.lit("")).alias("description"), F.lit("active").alias("status"), clean_labels(F.col("labels")).alias("labels"),
        F.coalesce("priority", F.lit(5)).alias("priority"), subtask_progress(F.col("description"), F.lit(0)).alias("progress"), "deadline", "created_at", F.col("created_at").alias("updated_at"),
    )


def clamped(priority):
    """A priority between 0 and 10."""
    return F.greatest(F.lit(0), F.least(F.lit(10), priority))


def updated(goals: DataFrame, patches: DataFrame) -> DataFrame:
    """Goals with patches (id, title, description, status, labels, priority, progress, deadline, at) applied.

    Empty texts, null labels and negative numbers leave a field as it is. A progress below 0 is computed again if the description changed and
    lists subtasks. updated_at is the patch's time. One patch per goal; patches of unknown goals change nothing.
    """
    p = patches.select("id", F.lit(True).alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("title", "description", "status", "labels", "priority", "progress", "deadline", "at")])
    g = goals.join(p, "id", "left")
    text = lambda c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c)
    number = lambda c: F.when(F.col(f"_{c}") >= 0, F.col(f"_{c}")).otherwise(F.col(c))
    changed = F.coalesce(F.col("_description"), F.lit("")) != ""
    progress = F.when(F.col("_progress") >= 0, F.col("_progress")).when(changed, subtask_progress(F.col("_description"), F.col("progress"))).otherwise(F.col("progress"))
    return g.select(
        "id", text("title"), text("description"), text("status"), F.coalesce(F.when(F.col("_labels").isNotNull(), clean_labels(F.col("_labels"))), F.col("labels")).alias("labels"),
        number("priority").alias("priority"), progress.alias("progress"), text("deadline"), "created_at", F.coalesce("_at", "updated_at").alias("updated_at"),
    )


def without(goals: DataFrame, ids: DataFrame) -> DataFrame:
    return goals.join(ids.select("id").distinct(), "id", "left_anti")


def mirror(goals: DataFrame) -> DataFrame:
    """key, content, summary, tags, source of each goal among the keyed values: a view, so a changed status leaves nothing behind."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active"))
    return goals.select(F.concat(F.lit("memory/goals/"), status, F.lit("/"), "id").alias("key"), F.col("description").alias("content"), F.col("title").alias("summary"), F.col("labels").alias("tags"), F.lit("goal-tracker").alias("source"))


def subtasks(goals: DataFrame) -> DataFrame:
    """id, position (from 1), done, task of every subtask of every description."""
    pattern = r"(?m)^\s*[-*+]\s+\[[ xX]\][^\n]*"
    rows = goals.select("id", F.posexplode(F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(pattern), F.lit(0))).alias("p", "line"))
    mark = r"^\s*[-*+]\s+\[([ xX])\]\s*"
    return rows.select("id", (F.col("p") + 1).alias("position"), (F.lower(F.regexp_extract("line", mark, 1)) == "x").alias("done"), F.regexp_replace(F.regexp_replace("line", mark, ""), r"\s+$", "").alias("task"))


def with_progress(goals: DataFrame) -> DataFrame:
    """id, done, total, percent of each goal's subtasks; percent is the stored progress where there are none."""
    marks = subtask_marks(F.col("description"))
    return goals.select("id", F.size(F.filter(marks, lambda m: F.lower(m) == "x")).alias("done"), F.size(marks).alias("total"), subtask_progress(F.col("description"), F.col("progress")).alias("percent"))


