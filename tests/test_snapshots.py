"""Stored snapshots: no shuffle of what is stored, only differing slices opened, micro-batches that may run twice."""

import glob
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import snapshot
from shelfmark.sources.snapshots import SnapshotTable, relist, start_refresh

ROOTS = ("/w", "/x")
KIND = "path string, root string, rel string, size long, mtime_ms long, is_text boolean, denied boolean, content_hash string"


def listing(spark, rows):
    return spark.createDataFrame([(f"{r}/{rel}", r, rel, size, 5, True, False, h) for r, rel, size, h in rows], KIND)


def snap(df, scan_id=1):
    return df.withColumns({"gone": F.lit(False), "scan_id": F.lit(scan_id).cast("bigint")})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def rows(spark):
    return [("/w", f"a/{i}.md", i, f"h{i}") for i in range(40)] + [("/x", f"{i}.md", i, None if i % 2 else "h") for i in range(20)]


@pytest.fixture()
def table(spark, scratch, rows):
    out = SnapshotTable(spark, "t" + uuid.uuid4().hex, scratch + "/snap", buckets=6, slices=8)
    out.write(snap(listing(spark, rows)), 0)
    return out


def held(df):
    return sorted(map(tuple, df.select("path", "size", "content_hash", "gone", "scan_id").collect()), key=str)


def test_merging_shuffles_the_listing_only(spark, table, rows):
    cur = listing(spark, rows[6:] + [("/w", "new.md", 1, "n"), ("/w", "a/5.md", 99, "c")])
    merged = snapshot.merge_snapshot(table.read(0).drop("slice"), cur, 2, ROOTS)
    text = plan(merged)
    assert "Bucketed: true" in text
    # Nothing stands between the join and the scan of the version but a sort; the other side is dealt to its buckets.
    assert "Exchange" not in text[:text.index("FileScan parquet")].split("SortMergeJoin")[1]
    assert re.findall(r"hashpartitioning\(path#\d+, (\d+)\)", text) == ["6"]
    both = table.read(0).alias("a").join(table.read(0).alias("b"), F.col("a.path") == F.col("b.path"), "full_outer")
    assert "Exchange" not in plan(both)


def test_merge_equals_the_plain_one_and_counts_on_the_way(spark, table, rows):
    cur = listing(spark, rows[3:] + [("/w", "new.md", 1, "n")])
    seen = table.merge(cur, 0, 2, ROOTS)
    want = snapshot.merge_snapshot(table.read(0).drop("slice"), cur, 2, ROOTS)
    assert held(table.read(1)) == held(want)
    as_rows = lambda df: sorted(map(tuple, df.select("root", "files_seen", "files_added", "files_updated", "files_reused", "files_removed").collect()))
    assert as_rows(snapshot.observed_run(spark, seen, ROOTS)) == as_rows(snapshot.scan_run_stats(want))
    files = glob.glob(table.path + "/rows-1/slice=*/*.parquet")
    assert len(files) <= table.buckets * table.slices  # each task wrote one bucket


def test_only_differing_slices_are_opened(spark, table, rows):
    changed = [("/w", "a/7.md", 7, "other")] + [r for r in rows if r[1] != "a/7.md"]
    table.write(snap(listing(spark, changed), 2), 1)
    columns = ("size", "content_hash")
    (one,) = table.differing_slices(0, 1)
    df = table.diff(0, 1, columns)
    assert "Exchange" not in plan(df) and re.search(r"PartitionFilters: \[.*slice", plan(df))
    for folder in glob.glob(table.path + "/rows-*/slice=*"):
        if not folder.endswith(f"={one}"):
            for part in glob.glob(folder + "/*.parquet"):
                size = os.path.getsize(part)
                with open(part, "r+b") as out:
                    out.write(b"x" * size)
    assert [tuple(r) for r in df.collect()] == [("/w/a/7.md", "content_hash", "h7", "other")]
    assert [tuple(r) for r in table.changed_folders(0, 1).collect()] == [("/w", "a", 40, 40)]


def test_equal_versions_and_empty_ones(spark, table, rows):
    table.write(snap(listing(spark, list(reversed(rows))), 9), 1)
    assert table.differing_slices(0, 1) == [] and table.diff(0, 1, ("size",)).collect() == []
    assert table.changed_folders(0, 1).collect() == []
    table.write(snap(listing(spark, [])), 2)
    assert table.diff(0, 2, ("size",)).count() == 60 and table.changed_folders(2, 0).count() == 2
    # A value that is null in one column and there in the next is another row.
    moved = listing(spark, rows).withColumns({"content_hash": F.lit(None).cast("string")})
    table.write(snap(moved), 3)
    assert table.diff(0, 3, ("content_hash",)).count() == 50


def test_a_repeated_micro_batch_neither_loses_nor_doubles(spark, table, rows, scratch):
    feed = scratch + "/feed"
    first = listing(spark, [("/w", "a/1.md", 100, "x"), ("/w", "n1.md", 1, "n")]).withColumn("scan_id", F.lit(5).cast("bigint"))
    later = listing(spark, [("/w", "a/1.md", 200, "y"), ("/x", "n2.md", 2, "n")]).withColumn("scan_id", F.lit(6).cast("bigint"))
    first.coalesce(1).write.mode("append").parquet(feed)
    stream = lambda: spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    table.publish(0)
    publish = table.publish

    def killed(version):
        raise RuntimeError("killed before it was published")

    table.publish = killed  # the version is written, the batch is not committed
    with pytest.raises(Exception, match="killed"):
        start_refresh(stream(), table, scratch + "/cp", ROOTS).awaitTermination()
    assert table.current() == 0
    table.publish = publish
    later.coalesce(1).write.mode("append").parquet(feed)
    start_refresh(stream(), table, scratch + "/cp", ROOTS).awaitTermination()
    assert table.current() == 2
    got = {r.path: (r.size, r.content_hash, r.gone) for r in table.read(2).collect()}
    assert len(got) == table.read(2).count() == 62 and got["/w/a/1.md"] == (200, "y", False) and got["/w/n1.md"][0] == 1 and got["/x/n2.md"][0] == 2
    relist(table, listing(spark, rows[:30]), 9, ROOTS)
    last = table.read(table.current())
    assert table.current() == 3 and last.where("gone").count() == 32 and last.where("gone").select("scan_id").distinct().collect()[0][0] == 9
    start_refresh(stream(), table, scratch + "/cp", ROOTS).awaitTermination()  # nothing new: nothing happens
    assert table.current() == 3
