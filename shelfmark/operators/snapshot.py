"""Comparing a listing with the last snapshot, merging the two, and what changed since."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfmark.model import CHANGE_KEYS, CONTENT_COLUMNS
from shelfmark.operators.ranking import each, first_per


def classify_snapshot(prev: DataFrame, cur: DataFrame, listed: Sequence[str],
                      keys: Sequence[str] = CHANGE_KEYS) -> DataFrame:
    """(path, root, action) for every path of either side, from narrow columns only.

    ``listed`` names the roots that the scan covered; they are configuration, so nothing is joined to find them.

    * ``reused``: in both, nothing about it changed, even if it had been gone in between
    * ``updated``: in both and changed
    * ``added``: new, or back with other content
    * ``removed``: vanished from a root that was listed
    * ``gone``: was gone before and still is
    * ``kept``: its root was not listed at all, so nothing is known about it
    """
    left = prev.select("path", "root", "gone", *keys, F.lit(True).alias("_in"))
    right = cur.select("path", "root", *keys, F.lit(True).alias("_in"))
    p, c = left.alias("p"), right.alias("c")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = p.join(c, F.col("p.path") == F.col("c.path"), "full_outer").select(
        F.coalesce("p.path", "c.path").alias("path"), F.coalesce("c.root", "p.root").alias("root"),
        F.col("p._in").alias("_old"), F.col("c._in").alias("_new"), F.col("p.gone").alias("_gone"),
        same.alias("_same"),
    )
    flagged = joined.withColumn("_listed", F.col("root").isin(*listed))
    action = (
        F.when(F.col("_new") & F.col("_old") & F.col("_same"), "reused")
        .when(F.col("_new") & F.col("_old") & ~F.col("_gone"), "updated")
        .when(F.col("_new"), "added")
        .when(F.col("_gone"), "gone")
        .when(F.col("_listed"), "removed")
        .otherwise("kept")
    )
    return flagged.select("path", "root", action.alias("action"))


def merge_snapshot(prev: DataFrame, cur: DataFrame, scan_id: int, listed: Sequence[str],
                   keys: Sequence[str] = CHANGE_KEYS) -> DataFrame:
    """The new snapshot: ``cur`` merged over ``prev``, with the ``action`` taken for each row.

    Unchanged rows keep what was extracted before and get the new scan id; new and changed rows take the content
    of ``cur`` where it has any; vanished rows turn gone and get the new scan id too, so a change feed sees them.
    Columns of content may be absent on both sides: merging a metadata table then moves no bodies at all.
    """
    cols = [c for c in prev.columns if c not in ("scan_id", "gone")]
    have = set(cur.columns)
    p = prev.withColumn("_in", F.lit(True)).alias("p")
    c = cur.withColumn("_in", F.lit(True)).alias("c")
    old, new, was_gone = F.col("p._in"), F.col("c._in"), F.col("p.gone")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}"))
    reused = old & new & same
    picked: list[Column] = []
    for name in cols:
        if name not in have:
            value = F.col(f"p.{name}")
        elif name in CONTENT_COLUMNS:
            value = F.when(reused | new.isNull(), F.col(f"p.{name}")).otherwise(F.col(f"c.{name}"))
        else:
            value = F.coalesce(F.col(f"c.{name}"), F.col(f"p.{name}"))
        picked.append(value.alias(name))
    joined = p.join(c, F.col("p.path") == F.col("c.path"), "full_outer").select(
        *picked, reused.alias("_reused"), old.alias("_old"), new.alias("_new"), was_gone.alias("_gone"),
        F.col("p.scan_id").alias("_scan"),
    )
    joined = joined.withColumn("_listed", F.col("root").isin(*listed))
    action = (
        F.when(F.col("_reused"), "reused")
        .when(F.col("_new") & F.col("_old") & ~F.col("_gone"), "updated")
        .when(F.col("_new"), "added")
        .when(F.col("_gone"), "gone")
        .when(F.col("_listed"), "removed")
        .otherwise("kept")
    )
    return joined.withColumn("action", action).select(
        *cols,
        F.col("action").isin("removed", "gone").alias("gone"),
        F.when(F.col("action").isin("gone", "kept"), F.col("_scan")).otherwise(F.lit(scan_id).cast("bigint"))
        .alias("scan_id"),
        "action",
    )


def scan_run_stats(actions: DataFrame) -> DataFrame:
    """What a scan did, per root."""
    n = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.groupBy("root").agg(
        n("reused", "updated", "added").alias("files_seen"), n("added").alias("files_added"),
        n("updated").alias("files_updated"), n("reused").alias("files_reused"), n("removed").alias("files_removed"),
    )


RUN_COUNTS = {
    "files": None, "files_seen": ("reused", "updated", "added"), "files_added": ("added",), "files_updated": ("updated",),
    "files_reused": ("reused",), "files_removed": ("removed",)}


def observe_run(merged: DataFrame, listed: Sequence[str]) -> tuple[DataFrame, Observation]:
    """``merged`` with an observation that counts, per listed root, what ``scan_run_stats`` counts.

    The counts are taken while the merge is written, so neither snapshot is read or joined again for them.
    """
    seen = Observation("scan run")
    counts = [
        F.count_if((F.col("root") == root) & (F.lit(True) if actions is None else F.col("action").isin(*actions))).alias(f"{i}:{name}")
        for i, root in enumerate(listed) for name, actions in RUN_COUNTS.items()]
    return merged.observe(seen, *(counts or [F.count(F.lit(1)).alias("all")])), seen


def observed_run(spark: SparkSession, seen: Observation, listed: Sequence[str]) -> DataFrame:
    """The rows of ``scan_run_stats`` for the listed roots, out of an observation whose write is done."""
    got = seen.get
    names = [n for n in RUN_COUNTS if n != "files"]
    rows = [(root, *(got[f"{i}:{n}"] for n in names)) for i, root in enumerate(listed) if got[f"{i}:files"]]
    return spark.createDataFrame(rows, "root string, " + ", ".join(f"{n} long" for n in names))


def scan_run_record(actions: DataFrame, walked: DataFrame, run_id: int, started_ms: int, finished_ms: int) -> DataFrame:
    """The log rows of a scan, one per root: counts of files, what the walk met (``walked``: root, dirs_seen,
    skipped_dirs, errors), times, and whether every entry could be read."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    rows = scan_run_stats(actions).join(walked.select("root", "dirs_seen", "skipped_dirs", "errors"), "root", "left")
    failed = F.coalesce("errors", F.lit(0)) > 0
    return rows.select(
        F.lit(run_id).cast("bigint").alias("run_id"), "root", F.lit(started_ms).cast("bigint").alias("started_ms"),
        F.lit(finished_ms).cast("bigint").alias("finished_ms"), "files_seen", "files_added", "files_updated", "files_removed",
        zero("dirs_seen"), zero("skipped_dirs"), zero("errors"), F.lit(finished_ms - started_ms).cast("bigint").alias("elapsed_ms"),
        (~failed).alias("ok"), F.when(failed, F.concat(F.col("errors").cast("string"), F.lit(" entries could not be read"))).alias("detail"))


def vanished(prev: DataFrame, cur: DataFrame, listed: Sequence[str]) -> DataFrame:
    """Live files of listed roots that the listing no longer has."""
    live = prev.where(~F.col("gone") & F.col("root").isin(*listed)).select("root", "path", "rel")
    return live.join(cur.select("path"), "path", "left_anti")


def unlisted_roots(prev: DataFrame, listed: Sequence[str]) -> DataFrame:
    """Roots with live files that were not part of the scan."""
    left = prev.where(~F.col("gone") & ~F.col("root").isin(*listed))
    return left.groupBy("root").agg(F.count(F.lit(1)).alias("files"))


def diff_snapshots(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, in_a, in_b) for every differing value; rows on one side only give the field ``only-in-…``."""
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    left = a.select(key, *columns, F.lit(True).alias("_in")).alias("a")
    right = b.select(key, *columns, F.lit(True).alias("_in")).alias("b")
    both = F.col("a._in") & F.col("b._in")
    none = F.lit(None).cast("string")
    differing = [
        F.when(both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")),
               F.struct(F.lit(c).alias("field"), text("a", c).alias("in_a"), text("b", c).alias("in_b")))
        for c in columns
    ]
    alone = F.when(F.col("b._in").isNull(), F.lit("only-in-a")).when(F.col("a._in").isNull(), F.lit("only-in-b"))
    one_sided = F.when(alone.isNotNull(), F.struct(alone.alias("field"), none.alias("in_a"), none.alias("in_b")))
    joined = left.join(right, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return each(joined, [F.coalesce(f"a.{key}", f"b.{key}").alias(key)], F.array(*differing, one_sided), "_d").select(
        key, "_d.*")


# -- change feed ----------------------------------------------------------------------------------


def change_feed(files: DataFrame, cursor: int, allow: DataFrame | None = None) -> DataFrame:
    """Rows touched after ``cursor``, ``change`` = live or removed; with an allow-list only the listed ones."""
    rows = files.where(F.col("scan_id") > cursor).withColumn(
        "change", F.when(F.col("gone"), "removed").otherwise("live"))
    return rows if allow is None else apply_allow_list(rows, allow)


def next_cursor(changes: DataFrame, cursor: int) -> DataFrame:
    """The largest scan id that was processed, or the old cursor when nothing was."""
    return changes.agg(F.greatest(F.coalesce(F.max("scan_id"), F.lit(cursor)), F.lit(cursor)).alias("cursor"))


def clean_rel() -> Column:
    """The relative path of a file as a manifest spells it."""
    return F.regexp_replace(F.regexp_replace(F.col("rel"), r"\\", "/"), r"^\./", "")


def apply_allow_list(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files the manifest lists, with its attribution columns.

    Joined on (root, rel), a key both sides hold once. Spark broadcasts the manifest when its measured size allows
    that, and shuffles both sides when it does not.
    """
    entries = manifest.withColumnsRenamed({"root": "_root", "path": "_rel"})
    return files.join(entries, (F.col("root") == F.col("_root")) & (clean_rel() == F.col("_rel"))).drop("_root", "_rel")


def latest_version(files: DataFrame) -> DataFrame:
    """One row per path out of a table that appends a row per change."""
    return first_per(files, ["path"], F.col("scan_id")).select(*files.columns)
