"""Walking folder trees on storage that executors see as ordinary paths.

Spark's file sources leave out hidden and empty files. This walk finds them as well, does not enter folders that
policy ignores, and records what it skipped. Each level of the tree is one Spark job: its folders are spread over the
tasks, every task lists its own, and the result is written to a shared folder, so a lost executor repeats only its
part of one level.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.extract import extract_documents
from shelfmark.policy import Policy, Root
from shelfmark.session import shared_dir
from shelfmark.sources.corpus import describe

ENTRY = ("root string, path string, name string, what string, size long, mtime_ms long, birthtime_ms long, "
         "depth int")
CONTENT_BATCH = 64


def _listing(policy: Policy):
    """What a task does with its folders: one row per entry, ``what`` says how the walk treats it."""
    ignored, suffixes, noise = set(policy.ignored_dirs), tuple(policy.bundle_suffixes), set(policy.noise_names)

    def what_is(entry: os.DirEntry, depth: int) -> str | None:
        if entry.is_symlink():
            return "symlink"
        if entry.is_dir(follow_symlinks=False):
            if entry.name in ignored:
                return "skipped"
            if entry.name.lower().endswith(suffixes):
                return "bundle"
            return "dir" if policy.max_depth is None or depth + 1 <= policy.max_depth else "skipped"
        return "file" if entry.is_file(follow_symlinks=False) and entry.name not in noise else None

    def rows(root: str, folder: str, depth: int) -> Iterator[tuple]:
        try:
            entries = list(os.scandir(folder))
        except OSError:
            yield root, folder, "", "error", 0, 0, 0, depth
            return
        for e in entries:
            try:
                if what := what_is(e, depth):
                    st = e.stat(follow_symlinks=False)
                    is_file = what == "file"
                    birth = int(getattr(st, "st_birthtime", 0) * 1000)
                    mtime = 0 if what == "symlink" else st.st_mtime_ns // 1_000_000
                    yield root, e.path, e.name, what, st.st_size if is_file else 0, mtime, birth, depth + 1
            except OSError:
                yield root, e.path, e.name, "error", 0, 0, 0, depth

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ENTRY.split(", ")]
        for batch in batches:
            for folder in batch.itertuples(index=False):
                yield pd.DataFrame(rows(folder.root, folder.path, folder.depth), columns=columns)

    return task


def walk(spark: SparkSession, roots: tuple[Root, ...], policy: Policy) -> DataFrame:
    """All entries below the roots, level by level."""
    base = shared_dir(spark, "walk")
    level = spark.createDataFrame([(r.path.rstrip("/"), r.path.rstrip("/"), 0) for r in roots],
                                  "root string, path string, depth int")
    for n in itertools.count():
        tasks = spark.sparkContext.defaultParallelism
        spread = level.select("root", "path", "depth").repartition(tasks, "path")
        spread.mapInPandas(_listing(policy), ENTRY).write.parquet(f"{base}/level={n}")
        level = spark.read.parquet(f"{base}/level={n}").where("what = 'dir'")
        if level.isEmpty():
            break
    return spark.read.parquet(base).drop("level")


def walked_files(entries: DataFrame, policy: Policy) -> DataFrame:
    """Files, links and bundles of a walk as a listing."""
    kept = entries.where(F.col("what").isin("file", "symlink", "bundle"))
    rel = F.substr(F.col("path"), F.length("root") + 2)
    rows = describe(kept.select("root", "path", rel.alias("rel"), "size", "mtime_ms", "birthtime_ms", "what"), policy)
    special = F.col("what") != "file"
    return rows.withColumns({
        "kind": F.when(special, F.col("what")).otherwise(F.col("kind")),
        "ext": F.when(F.col("what") == "symlink", F.lit("")).otherwise(F.col("ext")),
        "is_symlink": F.col("what") == "symlink", "is_text": F.col("is_text") & ~special,
        "denied": F.col("denied") & ~(F.col("what") == "bundle"),
    }).drop("what")


def walk_stats(entries: DataFrame) -> DataFrame:
    """Folders seen, folders skipped and errors per root; a root that cannot be listed is ``missing``."""
    what = F.col("what")
    return entries.groupBy("root").agg(
        (F.count_if(what == "dir") + 1).alias("dirs_seen"),
        F.count_if(what.isin("skipped", "bundle")).alias("skipped_dirs"), F.count_if(what == "error").alias("errors"),
        F.coalesce(F.max((what == "error") & (F.col("path") == F.col("root"))), F.lit(False)).alias("missing"))


def read_content(listing: DataFrame, policy: Policy) -> DataFrame:
    """Add ``content`` to text files that policy lets us read, and ``content_hash`` to all of these files.

    Other files are hashed piece by piece. A file that vanished meanwhile has neither.
    """
    schema = T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("content_hash", T.StringType())])
    cap = policy.max_text_bytes

    def load(path: str, keep: bool, wanted: bool) -> tuple[bytes | None, str | None]:
        if not wanted:
            return None, None
        try:
            with open(path, "rb") as f:
                if keep:
                    data = f.read()
                    return data, hashlib.sha256(data).hexdigest()
                return None, hashlib.file_digest(f, "sha256").hexdigest()
        except OSError:
            return None, None

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CONTENT_BATCH):
                part = batch.iloc[at:at + CONTENT_BATCH]
                wanted = ~part["denied"] & ~part["is_symlink"] & (part["kind"] != "bundle")
                keep = part["is_text"] & (part["size"] > 0) & ((part["size"] <= cap) if cap is not None else True)
                read = [load(*x) for x in zip(part["path"], keep, wanted)]
                yield part.assign(content=[r[0] for r in read], content_hash=[r[1] for r in read])

    return listing.mapInPandas(task, schema)


def index_folders(spark: SparkSession, roots: tuple[Root, ...], policy: Policy) -> DataFrame:
    """Walk, read and extract: rows of the files table."""
    return extract_documents(read_content(walked_files(walk(spark, roots, policy), policy), policy), policy)
