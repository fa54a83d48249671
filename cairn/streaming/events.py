"""Streams: the event log as a source, upserts of micro-batches, and jobs of fact extraction.

The batch operators work on streams' micro-batches as they are; this module holds what only streams need.
"""

from __future__ import annotations

import queue
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import models
from cairn.sources.store import VersionLog

EVENT = "id bigint, event_type string, key string, summary string, details string, created_at timestamp"
JOB = "id string, status string, facts int, error string"


def append_events(events: DataFrame, path: str) -> str | None:
    """Events at the end of the log. A log that cannot be written does not stop the caller's work: the error is given back, None if there is none."""
    try:
        events.write.mode("append").parquet(path)
    except Exception as e:
        return f"{type(e).__name__}: {e}"
    return None


class AsyncWriter:
    """Writes in the background, in order: up to `depth` pieces wait; with more, the caller writes its piece itself. close() waits until all is written.

    A piece that fails is in `errors`; the ones after it are written all the same.
    """

    def __init__(self, write: Callable[[DataFrame], None], depth: int = 64):
        self.write, self.errors, self.waiting = write, [], queue.Queue(depth)
        self.thread = InheritableThread(target=self._run, daemon=True)
        self.thread.start()

    def _one(self, rows: DataFrame) -> None:
        try:
            self.write(rows)
        except Exception as e:
            self.errors.append(e)

    def _run(self) -> None:
        while (rows := self.waiting.get()) is not None:
            self._one(rows)

    def submit(self, rows: DataFrame) -> bool:
        """Whether the rows wait for the background; false if they were written at once because too many wait."""
        try:
            self.waiting.put_nowait(rows)
            return True
        except queue.Full:
            self._one(rows)
            return False

    def close(self) -> None:
        self.waiting.put(None)
        self.thread.join()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).parquet(path)


def counts_by_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """day, event_type, n of a stream of events; events later than `late` behind the newest are left out, so that days get closed."""
    days = events.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return days.select(F.col("window.start").alias("day"), "event_type", "n")


def upsert_into(log: VersionLog) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows (key, value, created_at, n) as new versions.

    seq is made of the batch's number and the row's, so a batch that is written again after a failure gives the same versions:
    the current state is the same, however often it is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("key", "value", "created_at", (F.lit(number) * F.lit(1 << 40) + F.col("n")).cast("bigint").alias("seq"), F.lit(False).alias("deleted"))
        log.append(rows)

    return write


def extraction_jobs(model: models.Model, facts_path: str, jobs_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that extracts facts of texts (id, text) and writes them and the state of each job.

    A job is done with the number of its facts, or failed if the model's answer could not be read; a batch that fails as a whole is tried again
    by the stream. Folders are by batch, so a second try replaces the first.
    """

    def write(batch: DataFrame, number: int) -> None:
        asked = batch.select("id", models.fact_prompt(F.col("text")).alias("prompt"))
        replied = models.answers(asked, model).select("id", models.array_of(F.col("answer"), models.FACTS).alias("facts"), F.coalesce("error", F.lit("the answer holds no list")).alias("why"))
        replied.write.mode("overwrite").parquet(f"{facts_path}/batch={number}")
        kept = batch.sparkSession.read.parquet(f"{facts_path}/batch={number}")
        status = F.when(F.col("facts").isNull(), "failed").otherwise("done")
        jobs = kept.select("id", status.alias("status"), F.coalesce(F.size("facts"), F.lit(0)).alias("facts"), F.when(F.col("facts").isNull(), F.col("why")).alias("error"))
        jobs.write.mode("overwrite").parquet(f"{jobs_path}/batch={number}")

    return write
