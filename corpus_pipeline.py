"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import lines, mixing, neardup, packing, quality
from shelfmark.llm.catalog import KEEP_FROM, table
from shelfmark.llm.common import fresh, store


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of those at hand, does not reject."""
    score = quality.scorer(spark, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    name = fresh(docs, "_score")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) >= KEEP_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near duplicates at similarity 0.8.

    Rows are numbered, so that those that share an id, or have none, are members of their own; a null id stands after all others.
    """
    row = fresh(docs, "_row")
    rows = store(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    found = neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent=80, bands=24, rows=5)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row"))
    members = rows.select(F.col(row), place.alias("place")).join(found.select(F.col("doc_id").alias(row), "component_id"), row)
    best = members.groupBy("component_id").agg(F.min("place").alias("best")).hint("rebalance")
    gone = members.join(best, "component_id").where(F.col(row) != F.col("best.row")).select(row)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return mixing.mix(docs, prefix=prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# Learning and tokenising have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
