"""Joining rows to a summary of their group when one group may hold a large part of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.policy import Policy


def attach_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], spread: str, policy: Policy,
                 how: str = "left", count: str = "n") -> DataFrame:
    """Join ``rows`` with ``groups`` (one row per key, ``count`` = rows behind it) and add its columns.

    Rows of a hot key are spread over ``salt_buckets`` tasks by a hash of ``spread``; the summary of a hot key
    is repeated once per bucket. The list of hot keys has at most ``rows / hot_group_rows`` entries, so it may
    be broadcast; everything else goes through one ordinary shuffle join.
    """
    hot = groups.where(F.col(count) >= policy.hot_group_rows).select(*keys, F.lit(True).alias("_hot"))
    buckets = policy.salt_buckets
    salted_rows = (
        rows.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
                    .otherwise(F.lit(0)))
        .drop("_hot")
    )
    salted_groups = groups.withColumn(
        "_salt",
        F.explode(
            F.when(F.col(count) >= policy.hot_group_rows, F.sequence(F.lit(0), F.lit(buckets - 1)))
            .otherwise(F.array(F.lit(0)))
        ),
    )
    return salted_rows.join(salted_groups, [*keys, "_salt"], how).drop("_salt")
