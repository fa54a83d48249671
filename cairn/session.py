"""Session settings and the places where work is kept between stages."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cairn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator expects (UTC, AQE, Arrow).

    Cluster settings (executors, memory, spark.checkpoint.dir) come from spark-submit; only
    what changes results or plans is set here. `master` is for tests and the bench.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from spark.checkpoint.dir. Only where that is unset (tests, local runs) a local folder
    is made and set on the context.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(given)
        return given
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "cairn-checkpoints")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """`df` written as a parquet table in the shared folder and read again.

    Cuts the lineage like a checkpoint, but compressed, columnar and with statistics. Losing an executor after the
    write costs nothing. The folder goes with the Scratch it was made in, else when the driver ends.
    """
    path = stage_path(df.sparkSession, name)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as one of its own."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Staged tables that are deleted together, by drop(): the ones that only a step's own jobs read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = stage_path(self.spark, name)
        self.paths.append(path)
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            fs, p = file_system(self.spark, path)
            fs.delete(p, True)
        self.paths = []


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage. Spark removes shuffle files and broadcasts of plans that are gone only then, and a driver that
    makes many plans one after the other would keep them all until its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application: they may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="cairn-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    at = os.path.join(made, "cairn.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("cairn", os.path.relpath(full, root)))
    sc.addPyFile(at)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["Scratch", "build_session", "checkpoint_dir", "file_system", "release", "ship_package", "stage", "stage_path", "shuffle_width"]
