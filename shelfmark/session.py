"""Session settings the operators are written for."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site tracking doubles the time it takes to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "shelfmark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder every executor sees: the cluster's checkpoint folder, or a temporary one when none is set.

    The fallback only serves single-machine runs such as tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/shelfmark/{name}-{uuid.uuid4()}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), name)


def _folder(spark: SparkSession, path: str):
    """Hadoop's handle and file system of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A shared folder that goes when the driver's JVM ends, if nothing removes it before."""
    path = shared_dir(spark, name)
    at, files = _folder(spark, path)
    files.deleteOnExit(at)
    return path


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a step to a scratch folder and read it back: lineage ends here and no step is computed twice."""
    path = scratch_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


class Steps:
    """The stored steps of one run. ``drop`` removes those whose readers are written; a failure removes all.

    Steps that a lazy result still reads stay until the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: set[str] = set()

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self._remove(self.paths)

    def _remove(self, paths) -> None:
        for path in list(paths):
            at, files = _folder(self.spark, path)
            files.delete(at, True)
            self.paths.discard(path)

    def store(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        out = store(df, name, **options)
        self.paths.add(out._stored_at)
        return out

    def drop(self, *steps: DataFrame) -> None:
        self._remove(step._stored_at for step in steps)

    def sweep(self) -> None:
        """Have Spark remove the shuffle files of jobs that are done.

        It does so once the driver's JVM has collected what refers to them, which otherwise happens whenever its heap is full. What
        Python lets go in the first round the JVM finds in the second.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)
