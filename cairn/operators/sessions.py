"""Session snapshots: the latest of each project, and their history."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_project(project):
    return F.replace(project, F.lit("/"), F.lit("-"))


def saved(snapshots: DataFrame) -> DataFrame:
    """key, value, created_at, n: each snapshot (project, data, created_at, n) under its project's latest key and under its time."""
    base = F.concat(F.lit("session/project/"), safe_project(F.col("project")), F.lit("/"))
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return snapshots.select(F.explode(F.array(F.concat(base, F.lit("latest")), F.concat(base, stamp))).alias("key"), F.col("data").alias("value"), "created_at", "n")


def latest(snapshots: DataFrame) -> DataFrame:
    """project, data, created_at of each project's last snapshot. A partial aggregation: hot projects make no hot task."""
    last = F.max_by(F.struct("data", "created_at"), F.struct("created_at", "n"))
    return snapshots.groupBy(safe_project(F.col("project")).alias("project")).agg(last.alias("s")).select("project", "s.data", "s.created_at")


def expired(rows: DataFrame, now: datetime, age: timedelta = timedelta(days=7)) -> DataFrame:
    """Rows of the history (key, created_at) older than `age`, exactly `age` old ones not; seven days for an age of 0 or less. Latest keys stay whatever their age."""
    keep = age if age > timedelta(0) else timedelta(days=7)
    return rows.where(F.col("key").startswith("session/") & ~F.col("key").endswith("/latest") & (F.col("created_at") < F.lit(now - keep)))


def compacted(rows: DataFrame, now: datetime, age: timedelta = timedelta(days=7)) -> DataFrame:
    return rows.join(expired(rows, now, age).select("key").distinct(), "key", "left_anti")


def compact_count(rows: DataFrame, now: datetime, age: timedelta = timedelta(days=7)) -> DataFrame:
    """One row, removed: how many rows compacted() leaves out."""
    return rows.join(expired(rows, now, age).select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("removed"))
