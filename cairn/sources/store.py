"""The keyed store: an append-only log of versions and the views derived from it.

A log has key, value, created_at, seq (unique, growing) and deleted. The current state is the version with the largest
seq of each key, without deleted ones.
"""

from __future__ import annotations

import secrets
import threading
import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import file_system

LOG = "key string, value string, created_at timestamp, seq bigint, deleted boolean"


def current(log: DataFrame) -> DataFrame:
    """key, value, created_at (of the key's first version), modified_at (of its last): the last version of each key that is not deleted.

    Numbers and times are aggregated by hash, without a sort; the last version then takes its value along by key and seq, so
    values are shuffled once and none but the last is kept. Ties cannot occur: seq is unique. A filter on the key goes below all of it.
    """
    log = log.where(F.col("key").isNotNull())
    states = log.groupBy("key").agg(
        F.max("seq").alias("seq"), F.min_by("created_at", "seq").alias("created_at"), F.max_by("created_at", "seq").alias("modified_at"), F.max_by(F.coalesce("deleted", F.lit(False)), "seq").alias("_gone")
    )
    last = states.where(~F.col("_gone")).drop("_gone")
    met = last.join(log.select("key", "seq", "value"), ["key", "seq"])
    # A version that was written twice, by a batch that was tried again, is one.
    return met.groupBy("key", "seq", "created_at", "modified_at").agg(F.get(F.collect_set("value"), F.lit(0)).alias("value")).select("key", "value", "created_at", "modified_at")


class Sequence:
    """Numbers of versions without a look at the log: micros since 1970, then the writer's own number.

    They grow with time; two writers (of WRITERS) never give the same one, and one writer never gives one twice.
    """

    WRITERS = 1 << 12

    def __init__(self, writer: int | None = None):
        self.writer = secrets.randbelow(self.WRITERS) if writer is None else writer % self.WRITERS
        self.last, self.lock = 0, threading.Lock()

    def next(self, rows: int = 1) -> int:
        """The first of `rows` numbers, which are WRITERS apart."""
        with self.lock:
            first = max(time.time_ns() // 1000, self.last + 1)
            self.last = first + rows - 1
        return first * self.WRITERS + self.writer


def put(log: DataFrame, rows: DataFrame, first_seq: int, step: int = 1) -> DataFrame:
    """The log with `rows` (key, value, created_at, n: their order) appended as new versions."""
    new = rows.select("key", "value", "created_at", (F.lit(first_seq) + F.col("n") * step).cast("bigint").alias("seq"), F.lit(False).alias("deleted"))
    return log.select("key", "value", "created_at", "seq", "deleted").unionByName(new)


def delete(log: DataFrame, keys: DataFrame, first_seq: int, at: Column) -> DataFrame:
    """The log with a tombstone for each key of `keys` (key, n). Deleting what does not exist changes nothing."""
    new = keys.select("key", F.lit(None).cast("string").alias("value"), at.alias("created_at"), (F.lit(first_seq) + F.col("n")).cast("bigint").alias("seq"), F.lit(True).alias("deleted"))
    return log.select("key", "value", "created_at", "seq", "deleted").unionByName(new)


def with_auto_keys(rows: DataFrame, auto: Column) -> DataFrame:
    """`rows` (key, text, created_at) with a key made of the text's hash where `auto` is true or the key is empty."""
    from cairn.functions.text import auto_key

    made = auto_key(F.coalesce("text", F.lit("")), F.col("created_at"))
    return rows.withColumn("key", F.when(auto | F.col("key").isNull() | (F.col("key") == ""), made).otherwise(F.col("key")))


def get(kv: DataFrame, key: str) -> DataFrame:
    return kv.where(F.col("key") == key)


def get_batch(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """pos, key, value, found of each wanted key (pos, key), in order of pos; repeats stay, empty keys are left out."""
    wanted = keys.where(F.col("key").isNotNull() & (F.col("key") != ""))
    return wanted.join(kv.select("key", "value", F.lit(True).alias("found")), "key", "left").select("pos", "key", "value", F.coalesce("found", F.lit(False)).alias("found")).orderBy("pos")


def listing(kv: DataFrame, prefix: str, after: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """entry: names directly under a prefix; what lies deeper shows once, as a folder with a closing slash. Bounds on created_at are inclusive."""
    rows = kv.where(F.col("key").startswith(prefix))
    if after is not None:
        rows = rows.where(F.col("created_at") >= F.lit(after))
    if before is not None:
        rows = rows.where(F.col("created_at") <= F.lit(before))
    rest = F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key"))
    entry = F.when(F.instr(rest, "/") > 0, F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest)
    return rows.select(F.concat(F.lit(prefix), entry).alias("entry")).distinct()


def parsed_bound(text: str) -> datetime | None:
    """A bound given as RFC 3339 text; None, which means no bound, where it cannot be read."""
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")) if "T" in text else None
    except ValueError:
        return None


def leaves(kv: DataFrame, prefix: str) -> DataFrame:
    """All entries under a prefix at any depth."""
    return kv.where(F.col("key").startswith(prefix) & ~F.col("key").endswith("/"))


class VersionLog:
    """A log as a parquet folder that is only appended to. Concurrent readers see whole appends."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        rows.select("key", "value", "created_at", "seq", "deleted").write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """The log; empty while nothing was appended."""
        fs, p = file_system(self.spark, self.path)
        return self.spark.read.schema(LOG).parquet(self.path) if fs.exists(p) else self.spark.createDataFrame([], LOG)

    def compact(self, path: str) -> VersionLog:
        """A new log at `path` with only the last version of each key, deleted keys gone. Times of first versions are kept."""
        kv = current(self.read())
        last = self.read().groupBy("key").agg(F.max("seq").alias("seq"))
        kv.join(last, "key").select("key", "value", "created_at", "seq", F.lit(False).alias("deleted")).write.mode("errorifexists").parquet(path)
        return VersionLog(self.spark, path)
