"""Listing document stores as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import names, paths
from shelfmark.functions.text import regex_escape, sql_list
from shelfmark.policy import Policy, Root

BINARY_FILE = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def local_path(path: Column) -> Column:
    """The path without a ``file:`` scheme; other schemes stay."""
    return F.regexp_replace(path, r"^file:/+", "/")


def listing(raw: DataFrame, root: str, policy: Policy, with_content: bool) -> DataFrame:
    """``binaryFile`` rows as rows of the files table before extraction."""
    path = local_path(F.col("path"))
    base = root.rstrip("/") + "/"
    rows = raw.select(
        F.lit(root).alias("root"), path.alias("path"),
        F.substr(path, F.lit(len(base) + 1)).alias("rel"),
        F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"),
        *([F.col("content")] if with_content else []),
    )
    return describe(rows, policy)


def name_and_ext(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name", paths.base_name(F.col("rel"))).withColumn("ext", paths.extension(F.col("name")))


def kind_and_flags(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.withColumns({
        "kind": names.kind_of(policy), "is_text": names.is_text_ext(policy),
        "is_symlink": F.lit(False), "denied": names.is_denied(F.col("name"), policy),
    })


def describe(rows: DataFrame, policy: Policy) -> DataFrame:
    """Add everything that follows from the path: name, extension, kind, text and policy flags."""
    return kind_and_flags(name_and_ext(rows), policy)


def prune_paths(rows: DataFrame, policy: Policy) -> DataFrame:
    """Leave out what lies under ignored folders, too deep, or is noise; fold a bundle into one row.

    The row of a bundle carries its path, no size and kind ``bundle``.
    """
    folders = F.filter(F.split("rel", "/"), lambda s: s != "")
    dirs = F.slice(folders, F.lit(1), F.size(folders) - 1)
    suffix = lambda s: F.lower(s).rlike(f"(?:{'|'.join(map(regex_escape, policy.bundle_suffixes))})$")
    staged = rows.withColumn("_dirs", dirs).withColumn(
        "_bundle_at",
        F.coalesce(F.get(F.filter(F.transform("_dirs", lambda s, i: F.when(suffix(s), i + 1)), lambda i: i.isNotNull()),
                         F.lit(0)), F.lit(0)))
    # Folders in front of the bundle decide whether the walk gets there at all.
    walked = F.when(F.col("_bundle_at") > 0, F.slice("_dirs", F.lit(1), F.col("_bundle_at") - 1)).otherwise(F.col("_dirs"))
    staged = staged.withColumn("_walked", walked).where(
        ~F.arrays_overlap("_walked", F.expr(f"array({sql_list(policy.ignored_dirs)})")))
    if policy.max_depth is not None:
        staged = staged.where(F.size("_walked") <= policy.max_depth)
    plain = staged.where((F.col("_bundle_at") == 0) & ~F.col("name").isin(*policy.noise_names))
    bundle_rel = F.array_join(F.slice("_dirs", F.lit(1), F.col("_bundle_at")), "/")
    bundles = (
        staged.where(F.col("_bundle_at") > 0).withColumn("rel", bundle_rel)
        .groupBy("root", "rel").agg(F.max("mtime_ms").alias("mtime_ms"))
        .withColumns({
            "path": F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), F.col("rel")),
            "name": paths.base_name(F.col("rel")), "size": F.lit(0).cast("bigint"),
        })
        .withColumns({
            "ext": paths.extension(F.col("name")), "kind": F.lit("bundle"), "is_text": F.lit(False),
            "is_symlink": F.lit(False), "denied": F.lit(False),
        })
    )
    tail = [c for c in staged.columns if not c.startswith("_")]
    return plain.select(*tail).unionByName(bundles, allowMissingColumns=True).select(*tail)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def scan_files(spark: SparkSession, roots: tuple[Root, ...], policy: Policy, with_content: bool = False) -> DataFrame:
    """Files of all roots, pruned. A root that is missing contributes no rows (see ``root_status``).

    Without ``with_content`` Spark lists the files and reads none of them.
    """
    out = None
    for root in roots:
        if not _exists(spark, root.path):
            continue
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.path)
        rows = listing(raw if with_content else raw.drop("content"), root.path, policy, with_content)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(f"none of the roots exists: {[r.path for r in roots]}")
    return prune_paths(out, policy)


def root_status(spark: SparkSession, roots: tuple[Root, ...]) -> DataFrame:
    """(root, label, missing) for the configured roots."""
    return spark.createDataFrame(
        [(r.path, r.label, not _exists(spark, r.path)) for r in roots], "root string, label string, missing boolean")


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The files of a Parquet table as a stream, whether the table is one file or a folder of them.

    The path is given as a pattern that only it matches: a plain path has to be a folder, a pattern may match either.
    """
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def stream_files(spark: SparkSession, root: Root, policy: Policy, max_files: int = 1000) -> DataFrame:
    """New files of one root as a stream, with content. The schema has to be given for a stream."""
    raw = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files).load(root.path)
    )
    return listing(raw, root.path, policy, True)
