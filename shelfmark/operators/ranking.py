"""Top rows per group and running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark keeps ``k`` rows per group and task before the shuffle (WindowGroupLimit), so a group of any size
    sends at most ``k`` rows per map task.
    """
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def each(df: DataFrame, keep: Sequence[str | Column], items: Column, alias: str) -> DataFrame:
    """One row per non-null element of a computed array.

    A plain explode makes Spark check the size of the array first, in a filter that computes it a second time. The
    outer form computes it once; the rows it adds for empty arrays are dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(items).alias(alias)).where(F.col(alias).isNotNull())


def first_per(df: DataFrame, by: Sequence[str], order: Column, newest: bool = True) -> DataFrame:
    """One whole row per group, picked by the largest (or smallest) ``order``; combined on the map side."""
    pick = F.max_by if newest else F.min_by
    rest = [c for c in df.columns if c not in by]
    return (
        df.groupBy(*by).agg(pick(F.struct(*rest), order).alias("_row")).select(*by, "_row.*")
    )


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put frames of one row each next to each other, without a join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def trim_to_bytes(lines: DataFrame, limit: int = 24_000, reserve: int = 200, by: str = "doc",
                  position: str = "position", text: str = "line") -> DataFrame:
    """Leading lines of each document that fit into ``limit - reserve`` UTF-8 bytes, line feeds counted.

    A line costs one byte at least, so later positions than the budget cannot fit and are left out first.
    """
    room = limit - reserve
    w = W.partitionBy(by).orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    head = lines.where(F.col(position) < room)
    return (
        head.withColumn("used_bytes", F.sum(F.octet_length(text) + F.lit(1)).over(w))
        .where(F.col("used_bytes") <= room)
    )
