"""Writing results: batches as JSON lines, events by append, tables by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.operators.claims import validate_claims


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What a job has written to a folder so far; no rows, if it had nothing to write yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_batches(payloads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Payloads as text files, one JSON document per line, exactly the bytes their digest was taken of."""
    payloads.select(F.col("payload_json").alias("value")).write.mode(mode).text(path)


def append_claims(events: DataFrame, path: str) -> DataFrame:
    """Append the valid events to the log and return the rejected ones with their reason."""
    good, bad = validate_claims(events)
    good.write.mode("append").parquet(path)
    return bad


def append_scan_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """A snapshot partitioned by root; only the partitions of the given roots are replaced."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root").parquet(path)


class VersionedTable:
    """A table kept as one folder per version.

    Writing version n again replaces it, so a micro-batch that is retried leaves the same result.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.folder(version))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.folder(version))

    def read_all(self, schema: StructType | None = None) -> DataFrame:
        """All versions together, for tables whose versions are increments. With a schema, there may be none yet."""
        if schema is not None and not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path).drop("version")
