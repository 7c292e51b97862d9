"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Columns both engines spell alike: whole numbers as bigint, fractions rounded, arrays joined."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "," if f.name == "matched_in" else "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def in_utc(spark: SparkSession) -> SparkSession:
    """Days and months are UTC on both sides."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def add(name: str, run: Run, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} exists already")
    QUERIES[name] = lambda spark, sf_dir: plain(run(in_utc(spark), sf_dir))
    if sql is not None:
        ORACLES[name] = sql
