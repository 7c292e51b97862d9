"""Counts and sums over the files table: roots, folders, kinds, months, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import dates, paths
from shelfmark.functions.text import in_list, squeeze
from shelfmark.operators import search
from shelfmark.operators.ranking import each, first_per, top_k
from shelfmark.policy import COVERAGE_LADDER, OPAQUE_EXTS, SANE_MTIME_MS, Policy


def live(files: DataFrame) -> DataFrame:
    return files.where(~F.col("gone"))


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.coalesce(F.max("mtime_ms"), F.lit(0)).alias("latest_ms"),
    ]


def root_stats(files: DataFrame) -> DataFrame:
    return live(files).groupBy("root").agg(*_sums())


def top_level_dirs(files: DataFrame) -> DataFrame:
    """Per root and top folder; loose files form the group with the empty name."""
    return live(files).groupBy("root", paths.top_dir(F.col("rel")).alias("top_dir")).agg(*_sums())


def kind_distribution(files: DataFrame) -> DataFrame:
    """Files and bytes per kind for the corpus, each root and each top folder, in one pass.

    ``grain`` says which of the three a row belongs to.
    """
    rows = live(files).select("root", paths.top_dir(F.col("rel")).alias("top_dir"), "kind", "size")
    grouped = rows.groupingSets(
        [["kind"], ["root", "kind"], ["root", "top_dir", "kind"]], "root", "top_dir", "kind"
    ).agg(
        F.grouping_id("root", "top_dir", "kind").alias("_g"),
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
    )
    grain = F.when(F.col("_g") == 6, "corpus").when(F.col("_g") == 2, "root").otherwise("top_dir")
    return grouped.select(grain.alias("grain"), "root", "top_dir", "kind", "files", "bytes")


def latest_scan_runs(scan_runs: DataFrame) -> DataFrame:
    return first_per(scan_runs, ["root"], F.col("run_id")).select(*scan_runs.columns)


def overview(files: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """Per root: files, bytes, what is searchable, and what the last scan saw and skipped."""
    covered = F.col("is_text") & (F.col("body_chars") > 0)
    per_root = live(files).groupBy("root").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(covered).alias("covered_files"),
        F.coalesce(F.sum(F.when(covered, F.col("size"))), F.lit(0)).alias("covered_bytes"),
    )
    runs = latest_scan_runs(scan_runs).select("root", "files_seen", "dirs_seen", "skipped_dirs", "errors")
    return per_root.join(runs, "root", "left")


def overview_totals(files: DataFrame) -> DataFrame:
    return live(files).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("is_text") & (F.col("body_chars") > 0)).alias("text_files"),
    )


# -- coverage -----------------------------------------------------------------------------------


def coverage_class(policy: Policy) -> Column:
    """What it would take to make a file searchable; one value of the coverage ladder."""
    kind = F.col("kind")
    return (
        F.when(F.col("gone") | F.col("is_symlink") | (F.col("size") == 0) | F.col("denied"), "excluded")
        .when(kind == "bundle", "skip")
        .when(F.col("body_chars") > 0, "ok")
        .when(F.lit(False) if policy.max_text_bytes is None else F.col("is_text") & (F.col("size") > policy.max_text_bytes), "chunk")
        .when(F.col("is_text") & F.col("is_binary"), "skip")
        .when(F.col("is_text"), "fix")
        .when(in_list("lower(ext)", OPAQUE_EXTS), "skip")
        .when(kind == "image", "ocr")
        .when(kind.isin("audio", "video"), "asr")
        .when(kind == "archive", "unpack")
        .when(kind.isin("doc", "sheet", "slide"), "extractor")
        .when(kind == "data", "nosql")
        .otherwise("skip")
    )


def classified(files: DataFrame, policy: Policy) -> DataFrame:
    return live(files).withColumn("bucket", coverage_class(policy))


def coverage_buckets(files: DataFrame, policy: Policy) -> DataFrame:
    """Files, bytes and share of each rung, in ladder order."""
    sums = classified(files, policy).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    rank = F.array_position(F.array(*[F.lit(b) for b in COVERAGE_LADDER]), F.col("bucket"))
    whole = W.partitionBy()  # ten rows at most
    return sums.select(
        "bucket", "files", "bytes",
        (F.col("files") * 100.0 / F.sum("files").over(whole)).alias("pct_files"),
        (rank - 1).cast("int").alias("ladder"),
    ).orderBy("ladder")


def coverage_top_exts(files: DataFrame, policy: Policy, k: int = 8) -> DataFrame:
    ext = F.when(F.col("ext") == "", F.lit("(none)")).otherwise(F.lower("ext"))
    counted = classified(files, policy).groupBy("bucket", ext.alias("ext")).agg(F.count(F.lit(1)).alias("files"))
    return top_k(counted, ["bucket"], [F.desc("files"), F.asc("ext")], k)


def coverage_samples(files: DataFrame, policy: Policy, k: int = 5) -> DataFrame:
    return top_k(classified(files, policy).select("bucket", "rel", "path"), ["bucket"],
                 [F.asc("rel"), F.asc("path")], k)


def coverage_report(files: DataFrame, policy: Policy) -> DataFrame:
    """One row per rung with its sums, its commonest extensions and a few sample paths."""
    exts = coverage_top_exts(files, policy).groupBy("bucket").agg(
        F.array_sort(F.collect_list(F.struct("rank", "ext", "files"))).alias("top_exts"))
    samples = coverage_samples(files, policy).groupBy("bucket").agg(
        F.array_sort(F.collect_list("rel")).alias("samples"))
    return coverage_buckets(files, policy).join(exts, "bucket", "left").join(samples, "bucket", "left")


def coverage_totals(files: DataFrame, policy: Policy) -> DataFrame:
    ok = F.col("bucket") == "ok"
    sums = classified(files, policy).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(ok).alias("searchable_files"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("searchable_bytes"),
        F.count_if("truncated").alias("truncated_files"),
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) * 100.0 / F.col(whole)).otherwise(F.lit(0.0))
    return sums.withColumns({
        "pct_files": share("searchable_files", "files"), "pct_bytes": share("searchable_bytes", "bytes"),
    })


def coverage_by_root(files: DataFrame) -> DataFrame:
    return live(files).groupBy("root").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        F.count_if(F.col("body_chars") > 0).alias("with_body"),
    ).withColumn("pct", F.col("with_body") * 100.0 / F.col("files"))


def biggest_dark(files: DataFrame, policy: Policy, k: int = 10) -> DataFrame:
    """The largest files nothing can be found in."""
    return (
        classified(files, policy).where(F.col("bucket") != "ok")
        .select("path", "rel", "size", "kind", "bucket").orderBy(F.desc("size"), "path").limit(k)
    )


# -- folders ------------------------------------------------------------------------------------


def _below(files: DataFrame, folder: str) -> DataFrame:
    base = folder.rstrip("/") + "/"
    rest = F.substr(F.col("path"), F.lit(len(base) + 1))
    return (
        live(files).where(~F.col("is_symlink") & F.startswith("path", F.lit(base)))
        .withColumn("rest", rest)
    )


def list_directory(files: DataFrame, folder: str, depth: int = 1, dirs_only: bool = False) -> DataFrame:
    """Entries of a folder down to ``depth`` levels: every subfolder with its whole subtree, and the files shown.

    A file adds one partial sum per level, combined before the shuffle; its row is never copied.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be between 1 and 6")
    rows = _below(files, folder)
    chain = F.slice(paths.folders_of(F.col("rest")), 1, depth)
    dirs = (
        each(rows, ["size", "mtime_ms"], chain, "entry")
        .groupBy("entry").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
                              F.max("mtime_ms").alias("latest_ms"))
        .select(F.lit("dir").alias("entry_type"), "entry", (paths.depth(F.col("entry")) + 1).alias("level"),
                "files", "bytes", "latest_ms")
    )
    if dirs_only:
        return dirs
    shown = rows.where(paths.depth(F.col("rest")) < depth).select(
        F.lit("file").alias("entry_type"), F.col("rest").alias("entry"),
        (paths.depth(F.col("rest")) + 1).alias("level"), F.lit(1).cast("bigint").alias("files"),
        F.col("size").alias("bytes"), F.col("mtime_ms").alias("latest_ms"),
    )
    return dirs.unionByName(shown)


def directory_total(files: DataFrame, folder: str) -> DataFrame:
    return _below(files, folder).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def recent_changes_by_dir(files: DataFrame, policy: Policy, since="7d", root: str | None = None,
                          kind=None, path_prefix: str | None = None) -> DataFrame:
    """All files changed since then, by top folder."""
    rows = search.filter_files(files, policy, root=root, kind=kind, since=since, path_prefix=path_prefix,
                               include_denied=True).where(~F.col("is_symlink"))
    return rows.groupBy(paths.top_dir(F.col("rel")).alias("top_dir")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def recent_changes(files: DataFrame, policy: Policy, since="7d", root: str | None = None, kind=None,
                   path_prefix: str | None = None, limit: int = 40) -> DataFrame:
    """The newest of them, each with the true total of its top folder beside it."""
    rows = search.filter_files(files, policy, root=root, kind=kind, since=since, path_prefix=path_prefix,
                               include_denied=True).where(~F.col("is_symlink"))
    page = (
        rows.select("path", "root", "rel", "kind", "size", "mtime_ms", squeeze(F.col("title")).alias("title"),
                    paths.top_dir(F.col("rel")).alias("top_dir"))
        .orderBy(F.desc("mtime_ms"), "path").limit(limit)
    )
    by_dir = recent_changes_by_dir(files, policy, since, root, kind, path_prefix).select(
        "top_dir", F.col("files").alias("dir_files"))
    # The page has at most ``limit`` rows, so it is the side to broadcast.
    return by_dir.join(F.broadcast(page), "top_dir")


def folder_totals(files: DataFrame) -> DataFrame:
    """Files and bytes of each top folder, loose files left out."""
    return (
        live(files).where(F.contains("rel", F.lit("/")))
        .groupBy(F.substring_index("rel", "/", 1).alias("folder"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    )


# -- time and types -----------------------------------------------------------------------------


def monthly_activity(files: DataFrame, policy: Policy, months: int = 12) -> DataFrame:
    """Files per month for ``months`` consecutive months up to the evaluation date; quiet months count 0."""
    spark = files.sparkSession
    this_month = F.trunc(F.to_date(F.timestamp_millis(F.lit(policy.as_of_ms))), "month")
    calendar = spark.range(1).select(
        F.explode(F.sequence(F.add_months(this_month, -(months - 1)), this_month, F.expr("interval 1 month"))).alias("d")
    ).select(F.date_format("d", "yyyy-MM").alias("month"))
    counted = (
        live(files).where(F.col("mtime_ms") > SANE_MTIME_MS)
        .groupBy(dates.month_key(F.col("mtime_ms")).alias("month")).agg(F.count(F.lit(1)).alias("files"))
    )
    # The calendar has ``months`` rows.
    return F.broadcast(calendar).join(counted, "month", "left").select("month", F.coalesce("files", F.lit(0)).alias("files"))


def recent3(monthly: DataFrame) -> DataFrame:
    """Files of the last three months of a monthly series."""
    return monthly.orderBy(F.desc("month")).limit(3).agg(F.sum("files").alias("recent3"))


def type_groups(files: DataFrame) -> DataFrame:
    """Content types with their share of the given files."""
    from shelfmark.operators.triage import content_type

    sums = live(files).groupBy(content_type().alias("content_type")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return sums.withColumn("fraction", F.col("files") / F.sum("files").over(W.partitionBy()))  # 13 rows at most


def scaled_bytes(files: DataFrame) -> DataFrame:
    """Bytes per kind on a square-root scale whose peak is 1, so that small kinds stay visible."""
    sums = live(files).groupBy("kind").agg(F.sum("size").alias("bytes"))
    root = F.sqrt(F.greatest("bytes", F.lit(0)))
    return sums.withColumn("scaled", root / F.greatest(F.max(root).over(W.partitionBy()), F.lit(1.0)))  # a row per kind
