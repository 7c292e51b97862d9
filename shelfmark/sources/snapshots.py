"""Stored snapshots that meet without a shuffle, and that tell where they differ before their rows are read.

A version of a snapshot is a table bucketed and sorted by ``path``, in folders by slice, a hash of the path. Merging a listing
moves the listing only; comparing two versions moves neither. Beside each version lie its digests: per slice and top
folder the number of rows and sums of two hashes of them, whatever their order. Slices with equal digests hold equal rows, so a comparison
opens only the others; folders that changed are known from the digests alone.

A version is written under its number and then published: readers take the one that ``current`` names, and that name is replaced in
one step. A micro-batch writes the version after its own number, from the version of its number; done again after a failure
it replaces the same version with the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions import paths
from shelfmark.operators.ranking import first_per
from shelfmark.operators.summaries import signed_changes
from shelfmark.operators.snapshot import diff_snapshots, merge_snapshot, observe_run

NOT_COMPARED = ("scan_id", "action", "slice")  # what a scan changes about a row that did not change


def row_hashes(columns: Sequence[str]) -> list[Column]:
    """Two hashes of a row, whatever the order of its columns. A hash leaves nulls out, so each column is told by whether it is null as well."""
    parts = [x for c in sorted(columns) for x in (F.isnull(F.col(c)), F.col(c))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


class SnapshotTable:
    """The versions of one corpus snapshot under ``path``; ``name`` begins the names of their tables in the catalog."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64, slices: int = 64) -> None:
        self.spark, self.name, self.path = spark, name, path.rstrip("/")
        self.buckets, self.slices = buckets, slices

    def table(self, version: int) -> str:
        return f"{self.name}_v{version}"

    def slice_of(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.slices)).cast("int")

    def write(self, rows: DataFrame, version: int, placed: bool = False) -> None:
        """Store a version and its digests. ``placed``: rows of a bucket are in one task already, as after a join with a version."""
        rows = rows.drop("slice")
        if not placed:
            rows = rows.repartition(self.buckets, "path")
        rows.withColumn("slice", self.slice_of(F.col("path"))).write.mode("overwrite").format("parquet").option(
            "path", f"{self.path}/rows-{version}").partitionBy("slice").bucketBy(self.buckets, "path").sortBy("path").saveAsTable(self.table(version))
        stored = self.read(version)
        first, second = row_hashes([c for c in stored.columns if c not in NOT_COMPARED])
        wide = lambda c: F.sum(c.cast("decimal(38,0)"))
        stored.groupBy("slice", "root", paths.top_dir(F.col("rel")).alias("top_dir")).agg(
            F.count("*").alias("files"), wide(first).alias("first"), wide(second).alias("second")).write.mode("overwrite").parquet(
            f"{self.path}/digests-{version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.table(self.table(version))

    def digests(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/digests-{version}")

    def changed(self, a: int, b: int, keys: Sequence[str]) -> DataFrame:
        """(keys, files_a, files_b) of the groups of folders whose rows differ. Reads digests only."""
        sides = [self.digests(v).groupBy(*keys).agg(*(F.sum(c).alias(f"{c}_{side}") for c in ("files", "first", "second")))
                 for v, side in ((a, "a"), (b, "b"))]
        differ = F.lit(False)
        for c in ("files", "first", "second"):
            differ = differ | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
        return sides[0].join(sides[1], list(keys), "full_outer").where(differ).select(*keys, zero("files_a"), zero("files_b"))

    def changed_folders(self, a: int, b: int) -> DataFrame:
        """(root, top_dir, files_a, files_b) of the top folders that differ between two versions."""
        return self.changed(a, b, ("root", "top_dir"))

    def differing_slices(self, a: int, b: int) -> list[int]:
        """At most ``slices`` numbers, whatever the size of the snapshots."""
        return sorted(r.slice for r in self.changed(a, b, ("slice",)).collect())

    def diff(self, a: int, b: int, columns: Sequence[str]) -> DataFrame:
        """``snapshot.diff_snapshots`` of two versions; equal slices are not read, and nothing is shuffled."""
        wanted = self.differing_slices(a, b)
        sides = [self.read(v).where(F.col("slice").isin(wanted)) for v in (a, b)]
        return diff_snapshots(*sides, "path", columns)

    def changes(self, a: int, b: int, columns: Sequence[str]) -> DataFrame:
        """``summaries.signed_changes`` from one version to another; equal slices are not read, and nothing is shuffled."""
        wanted = self.differing_slices(a, b)
        return signed_changes(*(self.read(v).where(F.col("slice").isin(wanted)) for v in (a, b)), columns)

    def merge(self, cur: DataFrame, version: int, scan_id: int, listed: Sequence[str], known: bool = True) -> Observation | None:
        """Merge a listing over a version, as the next one. What the scan did is counted in the same pass (``snapshot.observed_run``).

        ``known`` false: the rows of ``cur`` are changes, not a listing; nothing vanishes.
        """
        prev = self.read(version).drop("slice", "action")
        merged, seen = observe_run(merge_snapshot(prev, cur, scan_id, listed if known else ()), listed)
        self.write(merged.drop("action"), version + 1, placed=True)
        return seen

    # -- publication

    def _paths(self, *names: str):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(jvm.Path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        return context, [jvm.Path(f"{self.path}/{n}") for n in names]

    def publish(self, version: int) -> None:
        """Name a version as the current one: a file of its own, renamed over the old one in one step."""
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").json(f"{self.path}/next")
        context, (folder, current) = self._paths("next", "current")
        part = next(str(f.getPath()) for f in context.util().listStatus(folder) if str(f.getPath().getName()).startswith("part-"))
        jvm = self.spark._jvm
        replace = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(jvm.org.apache.hadoop.fs.Path(part), current, replace)

    def current(self) -> int | None:
        """The version readers use; none, if nothing has been published."""
        context, (current,) = self._paths("current")
        if not context.util().exists(current):
            return None
        return self.spark.read.schema("version long").json(f"{self.path}/current").first().version


def start_refresh(changes: DataFrame, table: SnapshotTable, checkpoint: str, listed: Sequence[str], first_scan: int = 1) -> StreamingQuery:
    """Merge every micro-batch of extracted rows into the snapshot and publish it; version 0 has to be there.

    The newest row of a path in a batch counts. A stream only sees files that are there, so what vanished is found by ``relist``.
    """
    def batch(rows: DataFrame, number: int) -> None:
        newest = first_per(rows, ["path"], F.col("scan_id")).select(*rows.columns).drop("scan_id", "gone")
        table.merge(newest, number, first_scan + number, listed, known=False)
        table.publish(number + 1)

    return (
        changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def relist(table: SnapshotTable, listing: DataFrame, scan_id: int, listed: Sequence[str]) -> Observation | None:
    """The periodic full listing: merged over the current version, so that removals are noticed, and published."""
    version = table.current() or 0
    seen = table.merge(listing, version, scan_id, listed)
    table.publish(version + 1)
    return seen
