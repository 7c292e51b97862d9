"""Sorting files into six attention tiers by rules, each verdict with its grounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import names, paths
from shelfmark.functions.text import any_true, contains_any, in_list, token_pattern
from shelfmark.operators.skew import attach_group
from shelfmark.policy import NOISE_NAMES, Policy

# ---------------------------------------------------------------------------------------------
# Word and extension lists of the rules.
# ---------------------------------------------------------------------------------------------

CHAT_WORDS = ("chat", "wechat", "weixin", "message", "email", "mail", "im", "conversation")
MAIL_EXTS = (".eml", ".msg")
CONFIG_EXTS = (".conf", ".cfg", ".ini", ".properties", ".env", ".plist", ".lock", ".sum",
               ".editorconfig", ".gitignore", ".dockerignore", ".npmrc")
INSTALLER_EXTS = (".dmg", ".pkg", ".mpkg", ".iso", ".msi", ".deb", ".rpm", ".appimage",
                  ".zip", ".tar", ".gz", ".tgz", ".7z", ".rar", ".xz", ".bz2")
MODEL_EXTS = (".safetensors", ".gguf", ".ckpt", ".onnx", ".pt", ".pth", ".h5", ".mlmodel", ".tflite")
BINARY_EXTS = (".dylib", ".so", ".dll", ".exe", ".node", ".a", ".o", ".class", ".jar", ".wasm")
PROSE_EXTS = (".md", ".markdown", ".txt", ".rtf", ".doc", ".docx", ".pdf", ".pages", ".ppt", ".pptx",
              ".key", ".epub")
STRUCTURED_EXTS = (".json", ".yaml", ".yml", ".toml", ".csv", ".tsv", ".xml", ".xlsx", ".xls", ".numbers",
                   ".db", ".sqlite", ".parquet")
SOURCE_EXTS = (".swift", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".py", ".rb", ".go", ".rs", ".kt", ".kts",
               ".java", ".c", ".h", ".cpp", ".hpp", ".m", ".mm", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".sql",
               ".php", ".lua", ".r", ".html", ".htm", ".css", ".scss", ".vue", ".svelte")
MEDIA_EXTS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".heif", ".tiff", ".bmp",
              ".mp4", ".mov", ".avi", ".mkv", ".flv", ".wmv", ".webm", ".m4v",
              ".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg")
ASSET_EXTS = (".sketch", ".fig", ".xd", ".psd", ".ai", ".eps", ".svg", ".indd", ".afdesign")

VENDOR_DIRS = ("models", "platform-tools", "sdk", "third_party", "thirdparty", "extern", "external", "deps",
               "vendor", "node_modules", "site-packages")
VENDOR_STEMS = ("notice", "license", "licenses", "licence", "copying", "copyright", "merges", "vocab",
                "changelog", "authors", "contributors")
BUILD_DIRS = ("releases", "dist", "build", "out", "target", "node_modules", ".git", "coverage", "deriveddata",
              ".build", "pods", "vendor", "__pycache__", ".venv", "venv", "site-packages")
DEPENDENCY_MARKERS = ("node_modules/", "/.build/", "/venv/", "/.venv/", "/site-packages/", "/pods/", "/dist/",
                      "/build/", "/__pycache__/", "/vendor/", "/.next/", "/target/", "/deriveddata/", "/.gradle/",
                      "/.cargo/")
ENTRY_WORDS = ("readme", "spec", "agents", "claude", "index", "契约", "台账", "规则", "规范", "说明", "背景",
               "章程", "原则", "指南", "总览", "对应", "方案", "复盘")
ENTRY_EXTS = (".md", ".markdown", ".txt", ".rst", "")

DENSITY = {"prose": 100, "comms": 95, "structured": 80, "code": 70, "config": 40, "media": 30, "asset": 25}
SUBSTANTIAL_CHARS = 200

ARCHIVE_TOP = "归档/"
ARCHIVE_MARKS = ("/归档/", "备份-")
ARCHIVE_MARKS_ANY_CASE = ("/archive/",)
DOWNLOAD_TOP, DOWNLOAD_MARK = "downloads/", "/downloads/"
APP_SUFFIX, APP_MARK = ".app", ".app/"
# End of fixed values.

TIERS = ("must-read", "worth-reading", "skim", "undecided", "search-only", "excluded")


# -- predicates over name, ext, rel, kind ---------------------------------------------------------


def _name() -> Column:
    return F.lower("name")


def _rel() -> Column:
    return F.lower("rel")


def system_junk() -> Column:
    return in_list("lower(name)", [n.lower() for n in NOISE_NAMES])


def vendor_asset() -> Column:
    """Written by someone else: in a vendor folder, or a licence-like file by name."""
    return paths.has_segment(F.col("rel"), VENDOR_DIRS) | F.lower(paths.stem(F.col("name"))).isin(*VENDOR_STEMS)


def build_artifact() -> Column:
    return (paths.has_segment(F.col("rel"), BUILD_DIRS) | _rel().endswith(APP_SUFFIX)
            | F.contains(_rel(), F.lit(APP_MARK)))


def in_dependency() -> Column:
    return contains_any(F.concat(F.lit("/"), _rel()), DEPENDENCY_MARKERS)


def archived() -> Column:
    rel = F.col("rel")
    return rel.startswith(ARCHIVE_TOP) | contains_any(rel, ARCHIVE_MARKS) | contains_any(_rel(), ARCHIVE_MARKS_ANY_CASE)


def entry_doc() -> Column:
    """The document of a project that someone new should read first."""
    return (in_list("lower(ext)", ENTRY_EXTS) & ~in_dependency() & ~archived()
            & contains_any(_name(), ENTRY_WORDS))


def chat_named() -> Column:
    return _name().rlike("|".join(map(token_pattern, CHAT_WORDS)))


def content_type() -> Column:
    """What a file holds. Hard facts (folder, extension) come before guesses from the name."""
    kind = F.col("kind")
    ext_in = lambda exts: in_list(f"({paths.DOTTED})", exts)
    return (
        F.when(system_junk(), "junk")
        .when(vendor_asset(), "vendor")
        .when(ext_in(CONFIG_EXTS), "config")
        .when(ext_in(INSTALLER_EXTS), "installer")
        .when(ext_in(MODEL_EXTS), "model")
        .when(ext_in(BINARY_EXTS) | F.contains(_rel(), F.lit(APP_MARK)), "binary")
        .when(ext_in(PROSE_EXTS) | ((F.col("ext") == "") & ~F.contains(_name(), F.lit("."))), "prose")
        .when(ext_in(STRUCTURED_EXTS), "structured")
        .when(ext_in(SOURCE_EXTS), "code")
        .when(ext_in(MEDIA_EXTS), "media")
        .when(ext_in(ASSET_EXTS), "asset")
        .when(chat_named() | ext_in(MAIL_EXTS), "comms")
        .when(kind.isin("video", "audio", "image"), "media")
        .when(kind == "code", "code")
        .when(kind.isin("doc", "web"), "prose")
        .otherwise("unknown")
    )


def downloaded() -> Column:
    ct = content_type()
    in_folder = _rel().startswith(DOWNLOAD_TOP) | F.contains(_rel(), F.lit(DOWNLOAD_MARK))
    return F.when(in_folder, ct.isin("installer", "model", "binary")).otherwise(
        ct.isin("installer", "model") & F.col("name").rlike(r"\p{N}"))


def path_flags(files: DataFrame) -> DataFrame:
    return files.select(
        "path", content_type().alias("content_type"), names.machine_named(F.col("name")).alias("machine_named"),
        system_junk().alias("system_junk"), vendor_asset().alias("vendor_asset"),
        build_artifact().alias("build_artifact"), in_dependency().alias("in_dependency"),
        archived().alias("archived"), entry_doc().alias("entry_doc"), downloaded().alias("downloaded"),
    )


# -- duplicates by name and size ------------------------------------------------------------------


def mark_copies(files: DataFrame, policy: Policy) -> DataFrame:
    """Add ``copy_of``: the path of the first file with the same name and size, null for that file itself.

    Names and sizes are counted with partial sums; the answer comes back through a join that spreads hot groups.
    """
    groups = (
        files.groupBy("name", "size").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("_first"))
        .where(F.col("n") > 1)
    )
    joined = attach_group(files, groups, ["name", "size"], "path", policy).drop("n")
    return joined.withColumn("copy_of", F.when(F.col("_first") != F.col("path"), F.col("_first"))).drop("_first")


# -- the verdict ----------------------------------------------------------------------------------


def triage(files: DataFrame, policy: Policy, keep: Sequence[str] = ()) -> DataFrame:
    """Tier 0 (must read) … 5 (excluded) with content type, grounds and density.

    Reads names, sizes and ``body_chars`` only; the body column stays on disk. Columns in ``keep`` are carried along.
    """
    rows = (
        files.where(~F.col("gone") & ~F.col("is_symlink"))
        .select("path", "root", "rel", "name", "ext", "kind", "size", "mtime_ms", "body_chars", "truncated", *keep)
    )
    facts = mark_copies(rows, policy).withColumns({
        "content_type": content_type(), "_junk": system_junk(), "_built": build_artifact(),
        "_dep": in_dependency(), "_old": archived(), "_entry": entry_doc(),
    })
    ct, chars = F.col("content_type"), F.col("body_chars")
    opaque = ct.isin("installer", "model", "binary", "junk", "config", "vendor") | ((ct == "unknown") & (chars == 0))
    against = [
        F.when(opaque, F.concat(F.lit("type-holds-nothing-personal:"), ct)),
        F.when(ct == "vendor", F.lit("third-party-asset")),
        F.when(F.col("_junk"), F.lit("system-junk")),
        F.when(F.col("_built"), F.lit("build-artifact")),
        F.when(F.col("_dep"), F.lit("dependency-folder")),
        F.when(F.col("size") == 0, F.lit("empty-file")),
        F.when(F.col("copy_of").isNotNull(), F.concat(F.lit("same-name-and-size:"), F.col("name"))),
    ]
    excluded = any_true([g.isNotNull() for g in against])
    unreadable = ct.isin("media", "asset")
    searchable = ct.isin("code", "structured")
    worth = ct.isin("prose", "comms") & (chars >= SUBSTANTIAL_CHARS) & ~F.col("_old")
    tier = (
        F.when(excluded, 5).when(unreadable, 3).when(F.col("_entry"), 0).when(searchable, 4)
        .when(worth, 1).otherwise(2)
    )
    # A truncated body is longer than the number says.
    length = F.concat(F.lit("chars:"), chars.cast("string"), F.when(F.col("truncated"), F.lit("+")).otherwise(F.lit("")))
    has_body = F.when(chars > 0, F.concat(F.lit("body-"), length))
    size_note = (
        F.when(chars >= SUBSTANTIAL_CHARS, F.concat(F.lit("substantial-"), length))
        .when(chars > 0, F.concat(F.lit("short-"), length)).otherwise(F.lit("no-body"))
    )
    was_archived = F.when(F.col("_old"), F.lit("archived-may-be-superseded"))
    reasons = (
        F.when(excluded, F.array(*against))
        .when(unreadable, F.array(F.lit("content-not-machine-readable"), F.lit("name-and-path-searchable")))
        .when(F.col("_entry"), F.array(F.concat(F.lit("entry-document:"), F.col("name")), has_body, was_archived))
        .when(searchable, F.array(F.concat(F.lit("search-only:"), ct), F.coalesce(has_body, F.lit("no-body"))))
        .otherwise(F.array(F.concat(F.lit("may-hold-personal-content:"), ct), size_note, was_archived))
    )
    density = F.lit(0)
    for key, value in DENSITY.items():
        density = F.when(ct == key, value).otherwise(density)
    return facts.select(
        "path", "root", "rel", "name", "size", "mtime_ms", "content_type", tier.alias("tier"),
        F.array_compact(reasons).alias("reasons"), density.alias("density"), "copy_of", *keep,
    )


def triage_order(triaged: DataFrame, tier: int | None = None, limit: int | None = None) -> DataFrame:
    """Reading order: tier, information density, newest first."""
    rows = triaged if tier is None else triaged.where(F.col("tier") == tier)
    rows = rows.orderBy("tier", F.desc("density"), F.desc("mtime_ms"), "path")
    return rows if limit is None else rows.limit(limit)


def tier_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("tier").agg(F.count(F.lit(1)).alias("files"))


def signal_lift(triaged: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """(tier, signal, rate, lift): how much commoner a signal is in a tier than in the corpus.

    One pass counts every signal per tier; the corpus rate is the sum over those few rows.
    """
    counted = triaged.groupBy("tier").agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(c).alias(f"_{n}") for n, c in signals.items()])
    long = counted.select(
        "tier", "files",
        F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"_{n}").alias("hits")) for n in signals]))
        .alias("s"),
    ).select("tier", "files", "s.signal", "s.hits")
    w = W.partitionBy("signal")  # six rows per signal
    rate = F.col("hits") / F.col("files")
    base = F.sum("hits").over(w) / F.sum("files").over(w)
    return long.select("tier", "signal", rate.alias("rate"), F.when(base > 0, rate / base).alias("lift"))
