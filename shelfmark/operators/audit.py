"""Read-only audits: duplicates, same names, stale files, naming habits, inbox, root clutter, links; and proposals."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import dates, names, paths
from shelfmark.functions.text import in_list
from shelfmark.operators.links import broken_links, link_summary
from shelfmark.operators.ranking import side_by_side
from shelfmark.operators.search import page
from shelfmark.operators.skew import attach_group
from shelfmark.policy import UBIQUITOUS_NAMES, Policy

CHECKS = ("duplicates", "stale", "naming", "inbox", "root_clutter", "links")
# Fixed values.
SAME_NAME_MIN_BYTES = 1024
LONG_NAME = 60
# End of fixed values.


def present(files: DataFrame) -> DataFrame:
    return files.where(~F.col("gone") & ~F.col("is_symlink"))


# -- exact duplicates -----------------------------------------------------------------------------


def readable(files: DataFrame) -> DataFrame:
    return present(files).where(~F.col("denied") & (F.col("size") > 0))


def comparable(files: DataFrame) -> DataFrame:
    """Files whose bytes were hashed; the hash is a stored column, so no content is read here."""
    return readable(files).where(F.col("content_hash").isNotNull())


def size_groups(files: DataFrame) -> DataFrame:
    """Sizes that occur more than once; only such files can be equal."""
    return readable(files).groupBy("size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Groups of files of equal bytes: copies, bytes that could be freed, and the newest copy, which stays.

    Sizes and hashes are combined on the map side, so a file copied a billion times arrives as one row per task.
    """
    return (
        comparable(files).groupBy("size", F.col("content_hash").alias("hash"))
        .agg(F.count(F.lit(1)).alias("n"),
             F.max_by(F.struct("path", "rel"), F.struct("mtime_ms", "path")).alias("_keep"))
        .where(F.col("n") > 1)
        .select("size", "hash", "n", (F.col("size") * (F.col("n") - 1)).alias("wasted_bytes"),
                F.col("_keep.path").alias("keep_path"), F.col("_keep.rel").alias("keep_rel"))
    )


def duplicate_members(files: DataFrame, policy: Policy) -> DataFrame:
    """One row per copy, so that no group ever has to fit into one task."""
    rows = comparable(files).select("path", "root", "rel", "size", "mtime_ms", F.col("content_hash").alias("hash"))
    return attach_group(rows, duplicate_groups(files), ["size", "hash"], "path", policy, how="inner").withColumn(
        "is_keeper", F.col("path") == F.col("keep_path"))


def duplicate_summary(files: DataFrame) -> DataFrame:
    """Groups, reclaimable bytes, and files that could not be compared because their bytes were not read."""
    groups = duplicate_groups(files).agg(
        F.count(F.lit(1)).alias("exact_groups"),
        F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("reclaimable_bytes"))
    unread = F.col("content_hash").isNull()
    left = readable(files).agg(
        F.count_if(unread).alias("not_compared"),
        F.coalesce(F.sum(F.when(unread, F.col("size"))), F.lit(0)).alias("not_compared_bytes"))
    return side_by_side(groups, left)


# -- same names -----------------------------------------------------------------------------------


def same_name_groups(files: DataFrame) -> DataFrame:
    """Names, upper and lower case alike, found more than once; names every project has are left out."""
    key = F.lower("name")
    return (
        present(files).where((F.col("size") >= SAME_NAME_MIN_BYTES) & ~in_list("lower(name)", UBIQUITOUS_NAMES))
        .groupBy(key.alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_bytes"))
        .where(F.col("n") > 1)
    )


def same_name(files: DataFrame, policy: Policy, k: int = 20) -> DataFrame:
    """All files of the ``k`` largest clusters, each row with the true size of its cluster."""
    top = same_name_groups(files).orderBy(F.desc("total_bytes"), "name_key").limit(k)
    rows = (
        present(files).where(F.col("size") >= SAME_NAME_MIN_BYTES)
        .select(F.lower("name").alias("name_key"), "path", "rel", "size", "mtime_ms")
    )
    return rows.join(F.broadcast(top), "name_key")  # k rows


# -- stale ----------------------------------------------------------------------------------------


def is_stale(policy: Policy) -> Column:
    return (F.col("mtime_ms") > 0) & (F.col("mtime_ms") < policy.cutoff_ms(policy.stale_days))


def stale(files: DataFrame, policy: Policy, k: int | None = 30) -> dict[str, DataFrame]:
    """``total``, ``by_dir`` and ``biggest`` of the files nobody touched for ``stale_days``."""
    old = present(files).where(is_stale(policy))
    return {
        "total": old.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")),
        "by_dir": old.groupBy(paths.top_dir(F.col("rel")).alias("top_dir")).agg(
            F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("mtime_ms").alias("latest_ms")),
        "biggest": page(old.select(
            "path", "rel", "name", "size", "mtime_ms",
            dates.days_ago(F.col("mtime_ms"), policy).alias("days"),
        ).orderBy(F.desc("size"), "path"), k),
    }


# -- names ----------------------------------------------------------------------------------------


def _nameable(files: DataFrame) -> DataFrame:
    return present(files).where((F.col("kind") != "bundle") & ~names.vendored(F.col("rel")))


def version_names(files: DataFrame, policy: Policy) -> DataFrame:
    """Names that carry a version word or the copy suffix of an operating system."""
    return (
        _nameable(files).withColumn("reason", names.naming_reason(F.col("name"), policy))
        .where(F.col("reason").isNotNull()).select("path", "rel", "name", "size", "mtime_ms", "reason")
    )


def long_names(files: DataFrame, n: int = LONG_NAME) -> DataFrame:
    length = F.length("name")
    return (
        _nameable(files).where((length > n) & ~names.looks_generated(F.col("name")))
        .select("path", "rel", "name", length.alias("name_chars"))
    )


# -- inbox and root -------------------------------------------------------------------------------


def inbox(files: DataFrame, policy: Policy) -> DataFrame:
    """Files waiting in the collecting folder, with the days they have waited. Needs ``policy.inbox_dir``."""
    if not policy.inbox_dir:
        raise ValueError("policy.inbox_dir is not set")
    folder = f"{policy.main_root.rstrip('/')}/{policy.inbox_dir}"
    days = dates.days_ago(F.col("mtime_ms"), policy)
    return (
        present(files).where(paths.under(F.col("path"), folder))
        .select("path", "rel", "name", "size", "mtime_ms", days.alias("days"))
        .withColumn("overdue", F.col("days") > policy.inbox_stale_days)
    )


def inbox_summary(files: DataFrame, policy: Policy) -> DataFrame:
    """One row. An unset folder is reported as not configured, never as zero files."""
    if not policy.inbox_dir:
        return files.sparkSession.range(1).select(
            F.lit(False).alias("configured"), F.lit(None).cast("bigint").alias("files"),
            F.lit(None).cast("bigint").alias("overdue_files"), F.lit(None).cast("bigint").alias("bytes"))
    return inbox(files, policy).agg(
        F.lit(True).alias("configured"), F.count(F.lit(1)).alias("files"),
        F.count_if("overdue").alias("overdue_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def root_clutter(files: DataFrame, policy: Policy, root: str | None = None) -> DataFrame:
    """Loose files of a root that are neither navigation nor declared entry documents."""
    return (
        present(files)
        .where((F.col("root") == (root or policy.main_root)) & ~F.contains("rel", F.lit("/"))
               & ~names.is_nav(F.col("name"), policy))
        .select("path", "rel", "name", "size", "mtime_ms")
    )


def root_dirs(files: DataFrame, policy: Policy, root: str | None = None) -> DataFrame:
    return (
        files.where(~F.col("gone") & (F.col("root") == (root or policy.main_root)) & F.contains("rel", F.lit("/")))
        .select(F.substring_index("rel", "/", 1).alias("top_dir")).distinct()
    )


# -- the summary of all checks --------------------------------------------------------------------


def _metrics(df: DataFrame, check: str) -> DataFrame:
    cols = [c for c in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in cols])
    return df.select(F.lit(check).alias("check"), F.explode(pairs).alias("_m")).select("check", "_m.*")


def audit(files: DataFrame, policy: Policy, checks: Sequence[str] = ("all",)) -> DataFrame:
    """(check, metric, value). Checks that only look at metadata share one scan; unknown names raise.

    A check without its configuration has ``configured = 0`` and null values.
    """
    wanted = CHECKS if "all" in checks else tuple(checks)
    unknown = [c for c in wanted if c not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks {unknown}; there are {CHECKS}")

    nameable = (F.col("kind") != "bundle") & ~names.vendored(F.col("rel"))
    loose = (F.col("root") == policy.main_root) & ~F.contains("rel", F.lit("/"))
    per_check: dict[str, dict[str, Column]] = {
        "stale": {
            "files": F.count_if(is_stale(policy)),
            "bytes": F.coalesce(F.sum(F.when(is_stale(policy), F.col("size"))), F.lit(0)),
        },
        "naming": {
            "matched": F.count_if(nameable & names.naming_reason(F.col("name"), policy).isNotNull()),
            "long_names": F.count_if(
                nameable & (F.length("name") > LONG_NAME) & ~names.looks_generated(F.col("name"))),
        },
        "root_clutter": {"files": F.count_if(loose & ~names.is_nav(F.col("name"), policy))},
    }
    if policy.inbox_dir:
        here = paths.under(F.col("path"), f"{policy.main_root.rstrip('/')}/{policy.inbox_dir}")
        late = dates.days_ago(F.col("mtime_ms"), policy) > policy.inbox_stale_days
        per_check["inbox"] = {
            "configured": F.lit(1), "files": F.count_if(here), "overdue_files": F.count_if(here & late),
            "bytes": F.coalesce(F.sum(F.when(here, F.col("size"))), F.lit(0)),
        }
    frames = []
    shared = {(c, m): col for c, ms in per_check.items() if c in wanted for m, col in ms.items()}
    if shared:
        row = present(files).agg(*[col.cast("bigint").alias(f"{c}.{m}") for (c, m), col in shared.items()])
        frames.append(row.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("check"), F.lit(m).alias("metric"), F.col(f"`{c}.{m}`").alias("value"))
            for c, m in shared])).alias("_m")).select("_m.*"))
    if "inbox" in wanted and not policy.inbox_dir:
        frames.append(_metrics(inbox_summary(files, policy), "inbox"))
    if "root_clutter" in wanted:
        frames.append(_metrics(root_dirs(files, policy).agg(F.count(F.lit(1)).alias("dirs")), "root_clutter"))
    if "duplicates" in wanted:
        same = same_name_groups(files).agg(F.count(F.lit(1)).alias("same_name_groups"))
        frames += [_metrics(duplicate_summary(files), "duplicates"), _metrics(same, "duplicates")]
    if "links" in wanted:
        frames.append(_metrics(link_summary(files, policy), "links"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# -- proposals ------------------------------------------------------------------------------------


def propose_organize(files: DataFrame, policy: Policy, root: str | None = None, k: int | None = None) -> DataFrame:
    """What one could move, archive or review: (category, action, from_rel, to_path, risk). Nothing is changed.

    All of them, unless the caller asks for the first ``k`` of each source.
    """
    where = root or policy.main_root
    now = datetime.fromtimestamp(policy.as_of_ms / 1000, tz=timezone.utc)
    here = files.where(F.col("root") == where)
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, category: str, action: str, to: Column, risk: str, origin: str = "rel") -> DataFrame:
        return df.select(F.lit(category).alias("category"), F.lit(action).alias("action"),
                         F.col(origin).alias("from_rel"), to.alias("to_path"), F.lit(risk).alias("risk"))

    def first(df: DataFrame, *order) -> DataFrame:
        return df if k is None else df.orderBy(*order).limit(k)

    newest = [F.desc("mtime_ms"), F.asc("path")]
    clutter = first(root_clutter(here, policy, where), *newest)
    if policy.inbox_dir:
        to_inbox = F.concat(F.lit(f"{policy.inbox_dir}/{now:%Y-%m}/"), F.col("name"))
        parts = [rows(clutter, "root-clutter", "move", to_inbox, "low")]
        late = first(inbox(files, policy).where("overdue"), "mtime_ms", "path")
        parts.append(rows(late, "inbox-backlog", "triage", none, "manual"))
    else:
        parts = [rows(clutter, "root-clutter", "triage", none, "manual")]

    copies = first(duplicate_members(here, policy).where(~F.col("is_keeper")), F.desc("wasted_bytes"), "hash", "path")
    to_archive = F.concat(F.lit(f"归档/{now:%Y}/重复副本/"), paths.base_name(F.col("rel")))
    parts.append(rows(copies, "duplicates", "archive", to_archive, "medium"))

    versions = first(version_names(here, policy), *newest)
    parts.append(rows(versions, "version-names", "review", none, "manual"))
    big = first(stale(here, policy, None)["biggest"], F.desc("size"), "path")
    parts.append(rows(big, "stale-large", "review", F.lit(f"归档/{now:%Y}/（待定）/"), "manual"))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def proposal_summary(proposals: DataFrame) -> DataFrame:
    """Proposals per category with the risks that occur in it (three values at most)."""
    return proposals.groupBy("category").agg(
        F.count(F.lit(1)).alias("proposals"), F.array_sort(F.collect_set("risk")).alias("risks"))


__all__ = [
    "CHECKS", "audit", "broken_links", "duplicate_groups", "duplicate_members", "duplicate_summary",
    "inbox", "inbox_summary", "long_names", "proposal_summary", "propose_organize", "root_clutter", "root_dirs",
    "same_name", "same_name_groups", "size_groups", "stale", "version_names",
]
