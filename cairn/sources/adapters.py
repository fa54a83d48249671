"""The data folder's tables in the shapes that the operators read. Each has a twin in plans/sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import clean_labels, given_labels
from cairn.sources import store
from cairn.sources.tables import table


def memory_log(spark: SparkSession, folder: str) -> DataFrame:
    """The version log of memories; value is a small JSON text of content and summary, put together without escapes."""
    m = table(spark, folder, "memories")
    empty = F.lit("")
    value = F.concat(F.lit('{"content":"'), F.coalesce("value.content", empty), F.lit('","summary":"'), F.coalesce("value.summary", empty), F.lit('"}'))
    return m.select("key", value.alias("value"), F.date_trunc("second", "received_at").alias("created_at"), "seq", F.lit(False).alias("deleted"))


def memories(spark: SparkSession, folder: str) -> DataFrame:
    return store.current(memory_log(spark, folder))


def goals(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of each goal that is not deleted."""
    g = table(spark, folder, "goals")
    fields = ("title", "description", "status", "labels", "priority", "progress", "deadline")
    now = g.groupBy("id").agg(*[F.max_by(c, "seq").alias(c) for c in fields], F.min("received_at").alias("created_at"), F.max("received_at").alias("updated_at"), F.max_by(F.coalesce("deleted", F.lit(False)), "seq").alias("_gone"))
    labels = F.coalesce(given_labels(F.coalesce("labels", F.lit(""))), F.array().cast("array<string>"))
    return now.where(~F.col("_gone")).select("id", "title", "description", "status", clean_labels(labels).alias("labels"), "priority", "progress", "deadline", "created_at", "updated_at")


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "timeline_events").select("id", "event_type", "key", "summary", "details", F.col("received_at").alias("created_at"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """project, data, created_at, n of session snapshots."""
    d = table(spark, folder, "documents").where((F.col("kind") == "session") & F.col("project").isNotNull())
    return d.select("project", F.col("text").alias("data"), F.date_trunc("second", "created_at").alias("created_at"), F.col("doc_id").alias("n"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, relation, date of a small graph of places and those in them."""
    day = F.lit("2026-01-01").alias("date")
    n, r, c, s = (table(spark, folder, t) for t in ("nation", "region", "customer", "supplier"))
    places = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("in_region").alias("relation"), day)
    people = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"), F.lit("from_nation").alias("relation"), day)
    firms = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"), F.lit("from_nation").alias("relation"), day)
    return places.unionByName(people).unionByName(firms)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.concat(F.lit("memory/vec/"), F.col("vec_id").cast("string")).alias("key"), "embedding", "vec_id")


def vector_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values under the keys of vectors()."""
    d = table(spark, folder, "documents")
    return d.select(F.concat(F.lit("memory/vec/"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("content"), F.coalesce("project", F.lit("")).alias("summary"), F.date_trunc("second", "created_at").alias("created_at"), F.array_compact(F.array("kind", "source")).alias("tags"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("goal/"), F.col("doc_id").cast("string"))).alias("goal_id"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "agent_commands").select("command_id", "text", "answer", "labels", "lang")
