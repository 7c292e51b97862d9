"""Guessing the conventions of a corpus from its names; explicit configuration always wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.functions.text import clip, squeeze
from shelfmark.operators.ranking import first_per
from shelfmark.operators.rollup import kind_distribution, root_stats, top_level_dirs
from shelfmark.policy import Policy

# ---------------------------------------------------------------------------------------------
# Name patterns with their strength.
# ---------------------------------------------------------------------------------------------

ENTRY_NAMES = (
    (r"^00[-_\s.]", 100),
    (r"^0[-_\s.]", 90),
    (r"(?i)^readme([-_.].*)?$", 85),
    (r"(?i)^(index|overview|start|home)([-_.].*)?$", 80),
    (r"(?i)^(agents?|claude|cursor|gemini|copilot)\.md$", 75),
    (r"从这里开始|开始阅读|快速开始|入口|导航|总览|索引", 70),
    (r"(?i)^(maps?|toc|contents?|guide|handbook)([-_.].*)?$", 55),
)
LEDGER_NAMES = (
    (r"台账|清册|总表|汇总表", 90),
    (r"(?i)(^|[-_.])(ledger|registry|inventory|manifest|projects?|catalog)([-_.]|$)", 80),
)
RULES_NAMES = (
    (r"文件管理规则|管理规则|整理规则|命名规则", 95),
    (r"(?i)(^|[-_.])(rules?|conventions?|guidelines?|styleguide|contributing|standards?)([-_.]|$)", 85),
    (r"(^|[-_.])(规范|约定|规约|章程|制度)([-_.]|$)", 80),
)
NOTE_NAMES = (
    (r"(?i)^readme(\.[a-z]+)?$", 0),
    (r"^00[-_\s.]", 1),
    (r"(?i)^(index|overview|about)(\.[a-z]+)?$", 2),
)
NOTE_PREFIX = r"(?i)^(readme|index|00)"
NOTE_EXTS = (".md", ".txt", ".markdown")

# End of fixed values.

DEPTH_PENALTY = 15
MAX_DEPTH = 2


def name_score(name: Column, patterns: tuple[tuple[str, int], ...]) -> Column:
    out = F.lit(0)
    for pattern, score in reversed(patterns):
        out = F.when(name.rlike(pattern), score).otherwise(out)
    return out


def _present(files: DataFrame, root: str | None) -> DataFrame:
    rows = files.where(~F.col("gone") & ~F.col("is_symlink"))
    return rows if root is None else rows.where(F.col("root") == root)


def _scored(rows: DataFrame, patterns) -> DataFrame:
    return (
        rows.withColumns({"depth": paths.depth(F.col("rel")), "_base": name_score(F.col("name"), patterns)})
        .where((F.col("depth") <= MAX_DEPTH) & (F.col("_base") > 0))
        .withColumn("score", F.col("_base") - F.col("depth") * DEPTH_PENALTY).drop("_base")
    )


def discover_entry_docs(files: DataFrame, policy: Policy, root: str | None = None, k: int = 12) -> DataFrame:
    """Documents that look like the place to start reading, shallow ones first."""
    rows = _present(files, root or policy.main_root).where(
        F.col("kind").isin("doc", "web", "data") & (F.col("body_chars") > 0))
    return (
        _scored(rows, ENTRY_NAMES)
        .select("path", "rel", "name", squeeze(F.col("title")).alias("title"), "score", "depth")
        .orderBy(F.desc("score"), F.length("rel"), "rel").limit(k)
    )


def discover_dir_notes(files: DataFrame, policy: Policy, root: str | None = None) -> DataFrame:
    """(root, top_dir, note, source): the title of the best introductory document directly inside a folder."""
    rows = _present(files, root).where(
        F.col("ext").isin(*NOTE_EXTS) & (F.col("body_chars") > 0) & (paths.depth(F.col("rel")) == 1))
    rank = name_score(F.col("name"), NOTE_NAMES)
    note = squeeze(F.col("title"))
    candidates = rows.select(
        "root", paths.top_dir(F.col("rel")).alias("top_dir"), "rel", "name", note.alias("note"), rank.alias("_rank")
    ).where(((F.col("_rank") > 0) | F.col("name").rlike(NOTE_PREFIX)) & F.length("note").between(2, 70))
    best = first_per(candidates, ["root", "top_dir"], F.struct("_rank", F.length("rel"), "rel"), newest=False)
    return best.select("root", "top_dir", "note", F.col("rel").alias("source"))


def dir_notes(files: DataFrame, policy: Policy, root: str | None = None) -> DataFrame:
    """Top folders of a root with their purpose; a configured note beats a found one, and the source is named."""
    where = root or policy.main_root
    dirs = top_level_dirs(files.where(F.col("root") == where))
    found = discover_dir_notes(files, policy, where).select("top_dir", "note", "source")
    configured = F.lit(None).cast("string")
    for folder, text in policy.dir_notes.items():
        configured = F.when(F.col("top_dir") == folder, F.lit(text)).otherwise(configured)
    return dirs.join(found, "top_dir", "left").select(
        "root", "top_dir", "files", "bytes", "latest_ms",
        F.coalesce(configured, F.col("note")).alias("note"),
        F.when(configured.isNotNull(), F.lit("config")).otherwise(F.col("source")).alias("note_source"),
    )


def discover_ledger(files: DataFrame, policy: Policy, root: str | None = None, k: int = 5) -> DataFrame:
    """JSON and CSV files named like a list of projects; the caller checks the shape of these few."""
    rows = _present(files, root or policy.main_root).where(
        F.col("ext").isin(".json", ".csv") & (F.col("size") > 2))
    return _scored(rows, LEDGER_NAMES).select("path", "rel", "name", "ext", "score").orderBy(
        F.desc("score"), "rel").limit(k)


def discover_rules(files: DataFrame, policy: Policy, root: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """The document most likely to hold the owner's own rules (one row or none), with ``more`` of its columns."""
    rows = _present(files, root or policy.main_root).where(
        F.col("ext").isin(*NOTE_EXTS) & (F.col("body_chars") > 0))
    return _scored(rows, RULES_NAMES).select("path", "rel", "name", "score", *more).orderBy(
        F.desc("score"), F.length("rel"), "rel").limit(1)


def entry_docs(files: DataFrame, policy: Policy, root: str | None = None) -> DataFrame:
    """Configured entry documents in their order, then found ones, with file metadata.

    Configured positions count from 0, found ones go on behind the last of them; without any, they count from 1. Once something is configured, found documents below the top level are left out.
    """
    where = root or policy.main_root
    here = files.where(~F.col("gone") & (F.col("root") == where))
    found = discover_entry_docs(files, policy, where)
    listed = list(dict.fromkeys(d.replace("\\", "/") for d in policy.entry_docs))
    position = F.lit(None).cast("int")
    for i, rel in enumerate(listed):
        position = F.when(F.col("rel") == rel, i).otherwise(position)
    configured = here.where(F.col("rel").isin(*listed)).select(
        "rel", "path", "title", "name", "size", "mtime_ms", F.lit("config").alias("origin"), position.alias("_pos"))
    if listed:
        found = found.where((F.col("depth") == 0) & ~F.col("rel").isin(*listed))
    picked = found.select("path", (F.lit(max(len(listed) - 1, 0)) + F.row_number().over(
        W.orderBy(F.desc("score"), F.length("rel"), "rel"))).alias("_pos"))  # twelve rows at most
    auto = here.join(F.broadcast(picked), "path").select(
        "rel", "path", "title", "name", "size", "mtime_ms", F.lit("auto").alias("origin"), "_pos")
    title = F.coalesce(F.nullif(squeeze(F.col("title")), F.lit("")), F.col("name"))
    return configured.unionByName(auto).select(
        "rel", "path", clip(title, 80).alias("title"), "origin", "size", "mtime_ms",
        F.col("_pos").cast("int").alias("position"))


def discovery(files: DataFrame, policy: Policy, root: str | None = None) -> DataFrame:
    """(what, rel, origin): the rules and ledger documents in use and where that choice comes from."""
    where = root or policy.main_root
    spark = files.sparkSession
    out = None
    for what, configured, found in (
        ("ledger", policy.ledger_file, discover_ledger(files, policy, where, 1)),
        ("rules", policy.rules_file, discover_rules(files, policy, where)),
    ):
        if configured:
            row = spark.range(1).select(F.lit(what).alias("what"), F.lit(configured).alias("rel"),
                                        F.lit("config").alias("origin"))
        else:
            best = found.agg(F.max("rel").alias("rel"))
            row = best.select(F.lit(what).alias("what"), "rel",
                              F.when(F.col("rel").isNull(), "none").otherwise("auto").alias("origin"))
        out = row if out is None else out.unionByName(row)
    return out


def corpus_map(files: DataFrame, policy: Policy, projects: DataFrame | None = None) -> dict[str, DataFrame]:
    """The frames of the overview page; each is computed only when it is used."""
    from shelfmark.operators.extract import extract_rules
    from shelfmark.operators.projects import projects_by_group

    where = policy.main_root
    rules = policy.rules_file
    rules_docs = (
        files.where(~F.col("gone") & (F.col("root") == where) & (F.col("rel") == rules)) if rules
        else discover_rules(files, policy, more=("body",))
    )
    frames = {
        "roots": root_stats(files),
        "top_dirs": dir_notes(files, policy),
        "kinds": kind_distribution(files.where(F.col("root") == where)).where(F.col("grain") == "corpus"),
        "entry_docs": entry_docs(files, policy),
        "rules": extract_rules(rules_docs),
        "discovery": discovery(files, policy),
    }
    if projects is not None:
        frames["ledger_groups"] = projects_by_group(projects, policy)
    return frames
