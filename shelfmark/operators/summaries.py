"""Summaries that are kept up over changes, instead of being computed anew from all files.

One summary per corpus is stored: files, bytes and the newest change per root, top folder, kind, and further keys such as the
coverage rung. Root, folder and kind reports add up from it. After a scan it needs the rows that changed only: what they
were is taken off, what they are is put on. A maximum cannot be taken off; it is looked up again, but only for groups that lost the row
that held it. ``drift`` compares a kept summary with one computed anew.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators.ranking import each
from shelfmark.operators.rollup import coverage_class
from shelfmark.policy import Policy

KEYS = ("root", "top_dir", "kind")
MEASURES = ("files", "bytes", "latest_ms")


def keys_of(policy: Policy | None = None) -> dict[str, Column]:
    """The keys of a summary; with a policy the coverage rung is one of them."""
    out = {"root": F.col("root"), "top_dir": paths.top_dir(F.col("rel")), "kind": F.col("kind")}
    return out if policy is None else {**out, "bucket": coverage_class(policy)}


def summarise(files: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """The summary of all live files: a full pass."""
    return files.where(~F.col("gone")).select(*(c.alias(k) for k, c in keys.items()), "size", "mtime_ms").groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("mtime_ms").alias("latest_ms"))


def signed_changes(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(sign, path, columns): -1 with what a row was, +1 with what it is, for every path whose row differs in ``columns``."""
    side = lambda df, name: df.select("path", F.struct(*columns).alias("row"), F.lit(True).alias("is")).alias(name)
    joined = side(before, "b").join(side(after, "a"), F.col("b.path") == F.col("a.path"), "full_outer")
    row = lambda name, sign: F.when(F.col(f"{name}.is"), F.struct(F.lit(sign).alias("sign"), F.col(f"{name}.row").alias("row")))
    moved = joined.where(~F.col("b.row").eqNullSafe(F.col("a.row")))
    return each(moved, [F.coalesce("a.path", "b.path").alias("path")], F.array(row("b", -1), row("a", 1)), "_c").select(
        F.col("_c.sign").alias("sign"), "path", "_c.row.*")


def keep_up(summary: DataFrame, changes: DataFrame, after: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """The summary after ``changes`` (``signed_changes``). ``after`` is read for groups whose newest row went, if there are any."""
    names = list(keys)
    same = lambda a, b: F.expr(" AND ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in names))
    rows = changes.where(~F.col("gone")).select("sign", *(c.alias(k) for k, c in keys.items()), "size", "mtime_ms")
    delta = rows.groupBy(*names).agg(
        F.sum("sign").alias("files"), F.sum(F.col("sign") * F.col("size")).alias("bytes"),
        F.max(F.when(F.col("sign") > 0, F.col("mtime_ms"))).alias("new_ms"), F.max(F.when(F.col("sign") < 0, F.col("mtime_ms"))).alias("old_ms"))
    picked = lambda k: F.coalesce(F.col(f"s.{k}"), F.col(f"d.{k}")).alias(k)
    total = lambda c: (F.coalesce(F.col(f"s.{c}"), F.lit(0)) + F.coalesce(F.col(f"d.{c}"), F.lit(0))).alias(c)
    lost = F.coalesce((F.col("d.old_ms") >= F.col("s.latest_ms")) & (F.coalesce("d.new_ms", F.lit(-1)) < F.col("s.latest_ms")), F.lit(False))
    joined = summary.alias("s").join(delta.alias("d"), same("s", "d"), "full_outer").select(
        *(picked(k) for k in names), total("files"), total("bytes"), F.greatest("s.latest_ms", "d.new_ms").alias("latest_ms"), lost.alias("lost"))
    joined = joined.where("files > 0")
    again = summarise(after, keys).select(*names, F.col("latest_ms").alias("found_ms"))
    asked = again.alias("f").join(joined.where("lost").select(*names).alias("l"), same("f", "l"), "left_semi")
    return joined.alias("j").join(asked.alias("f"), same("j", "f"), "left").select(
        *(F.col(f"j.{k}").alias(k) for k in names), "files", "bytes", F.coalesce("found_ms", "latest_ms").alias("latest_ms"))


def drift(summary: DataFrame, files: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """Groups in which a kept summary differs from a full one; none, if it was kept up rightly."""
    names = list(keys)
    return summary.select(*names, *MEASURES).exceptAll(summarise(files, keys).select(*names, *MEASURES)).unionByName(
        summarise(files, keys).select(*names, *MEASURES).exceptAll(summary.select(*names, *MEASURES)))


# -- reports out of a summary

def _added(summary: DataFrame, *names: str) -> DataFrame:
    return summary.groupBy(*names).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.max("latest_ms").alias("latest_ms"))


def root_stats(summary: DataFrame) -> DataFrame:
    return _added(summary, "root")


def top_level_dirs(summary: DataFrame) -> DataFrame:
    return _added(summary, "root", "top_dir")


def kind_distribution(summary: DataFrame) -> DataFrame:
    """Per kind, in the corpus, each root and each top folder; ``grain`` says which."""
    grouped = summary.groupingSets([["kind"], ["root", "kind"], ["root", "top_dir", "kind"]], "root", "top_dir", "kind").agg(
        F.grouping_id("root", "top_dir", "kind").alias("_g"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    grain = F.when(F.col("_g") == 6, "corpus").when(F.col("_g") == 2, "root").otherwise("top_dir")
    return grouped.select(grain.alias("grain"), "root", "top_dir", "kind", "files", "bytes")


def coverage_buckets(summary: DataFrame) -> DataFrame:
    """Files and bytes per coverage rung, where the rung is a key."""
    return _added(summary, "bucket").drop("latest_ms")
