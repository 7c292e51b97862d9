"""Resolving local links against the files and folders of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names, paths
from shelfmark.operators.extract import extract_links
from shelfmark.operators.ranking import each, side_by_side
from shelfmark.operators.skew import attach_group
from shelfmark.policy import Policy

# Spellings a link may leave out.
COMPLETIONS = ("", ".md", ".markdown", ".html", "/index.md", "/README.md", "/readme.md")
# End of fixed values.


def link_target(path: Column, link: Column, policy: Policy) -> Column:
    """Absolute path a link of the document ``path`` points to."""
    relative = F.concat(paths.parent(path), F.lit("/"), link)
    at_home = F.concat(F.lit(policy.home), F.substr(link, F.lit(2)))
    return paths.normalize(
        F.when(link.startswith("/"), link).when(link.startswith("~"), at_home).otherwise(relative)
    )


def known_paths(files: DataFrame) -> DataFrame:
    """Every live path and every folder above one."""
    return each(files.where(~F.col("gone")), [], paths.ancestors(F.col("path")), "known").distinct()


def resolve_links(links: DataFrame, files: DataFrame, policy: Policy) -> DataFrame:
    """Links (``path``, ``link``) that point inside a root, with ``target`` and whether it ``exists``.

    Each distinct target is looked up once, in all its spellings, whatever the number of links to it.
    """
    # As an array of one, so that the filter below reads the target instead of resolving it once per root.
    located = each(links, links.columns, F.array(link_target(F.col("path"), F.col("link"), policy)), "target")
    inside = located.where(paths.inside_any(F.col("target"), policy.root_paths))
    targets = inside.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    spellings = targets.select(
        "target", F.explode(F.array(*[F.concat(F.col("target"), F.lit(c)) for c in COMPLETIONS])).alias("known"))
    found = spellings.join(known_paths(files), "known", "left_semi").select("target").distinct()
    answers = targets.join(found.withColumn("_hit", F.lit(True)), "target", "left").select(
        "target", "n", F.coalesce("_hit", F.lit(False)).alias("exists"))
    return attach_group(inside, answers, ["target"], "path", policy, how="inner").drop("n")


def markdown_links(files: DataFrame) -> DataFrame:
    """(path, rel, link) of Markdown documents, from the links that extraction stored beside the body."""
    docs = files.where(~F.col("gone") & names.is_markdown() & (F.col("body_chars") > 0))
    if "links" not in files.columns:
        return extract_links(docs.select("path", "rel", "body"))
    return each(docs, ["path", "rel"], F.col("links"), "link")


def broken_links(files: DataFrame, policy: Policy) -> DataFrame:
    """Links in Markdown bodies whose target is inside a root and does not exist under any spelling."""
    checked = resolve_links(markdown_links(files), files, policy)
    return checked.where(~F.col("exists")).select("path", "rel", "link", "target")


def link_summary(files: DataFrame, policy: Policy) -> DataFrame:
    """Documents looked at, links checked and links broken."""
    docs = files.where(~F.col("gone") & names.is_markdown() & (F.col("body_chars") > 0)).agg(
        F.count(F.lit(1)).alias("checked_files"))
    links = resolve_links(markdown_links(files), files, policy).agg(
        F.count(F.lit(1)).alias("checked_links"), F.count_if(~F.col("exists")).alias("broken"))
    return side_by_side(docs, links)
