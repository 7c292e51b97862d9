"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are summed per cell of source, language and topic. Raking scales the cells to the target of each dimension in turn, for a
fixed number of rounds; no cell may ask for more than its tokens at the sampling rate, as a document is taken at most once.
A document's probability is the rate times the factor of its cell, and it is taken if a hash of its id, as
a number from 0 to 1, is smaller.

Cells, targets and factors are tables, and each step is written to the shared folder; only sums over the whole corpus come to the
driver. Documents are joined with their cell by an ordinary join, which sends the cells where they are few and splits hot ones where
they are not.

Targets are shares by value, or one exponent for a dimension: shares then follow tokens ** exponent, which lifts small values.
Values without a share get none. Topics are named patterns, the first that occurs in the text counts.

Defined results: a null source or language is ``unknown``; null text has no tokens; documents in cells without tokens are taken at the rate;
rows that share an id share their fate; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Steps

DIMENSIONS = ("source", "lang", "topic")
TOPICS = {"contact": "@", "markup": "[{}<>]", "table": r" \| ", "figures": "[0-9]{3}"}
TARGETS = {"source": 0.8, "lang": 0.8, "topic": 0.8}
WORDS = "[^ \\t\\n\\r]+"
RATE, ROUNDS = 0.85, 8


def topic_of(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(topics.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def free_prefix(docs: DataFrame, prefix: str = "_") -> str:
    """``prefix``, made longer until no column of ``docs`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    return prefix


def described(docs: DataFrame, topics: Mapping[str, str], prefix: str) -> DataFrame:
    """The documents with the columns of their cell, prefixed, and their number of tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return docs.withColumns({f"{prefix}source": named("source"), f"{prefix}lang": named("lang"), f"{prefix}topic": topic_of(text, topics),
                             f"{prefix}tokens": F.regexp_count(text, F.lit(WORDS)).cast("long")})


def goals(cells: DataFrame, dimension: str, target: Mapping[str, float] | float, total: float) -> DataFrame:
    """(dimension, goal): tokens that each value of a dimension should get, as if nothing were left out."""
    sums = cells.groupBy(dimension).agg(F.sum("mass").alias("m"))
    if isinstance(target, Mapping):
        share = F.coalesce(F.create_map(*(F.lit(x) for kv in target.items() for x in kv))[F.col(dimension)], F.lit(0.0))
        return sums.select(dimension, (share * F.lit(total / sum(target.values()))).alias("goal"))
    lifted = F.pow("m", F.lit(float(target)))
    scale = sums.agg(F.sum(lifted)).first()[0]
    return sums.select(dimension, (lifted / F.lit(scale) * F.lit(total)).alias("goal"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rate: float = RATE, rounds: int = ROUNDS,
         steps: Steps | None = None) -> DataFrame:
    """(dimensions, mass, weight): cells whose weights meet the targets as far as ``mass / rate`` allows."""
    steps = steps or Steps(cells.sparkSession)
    total = cells.agg(F.sum("mass")).first()[0]
    if not total:
        return cells.withColumn("weight", F.col("mass"))
    wanted = {d: steps.store(goals(cells, d, targets[d], total), f"mix-{d}") for d in DIMENSIONS}
    last, now = None, cells.withColumn("weight", F.col("mass"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            sums = now.groupBy(d).agg(F.sum("weight").alias("is")).join(wanted[d], d)
            scaled = F.col("weight") * F.col("goal") / F.nullif(F.col("is"), F.lit(0.0))
            now = now.join(sums, d).select(*DIMENSIONS, "mass", F.least(
                F.coalesce(scaled, F.lit(0.0)), F.col("mass") / F.lit(rate)).alias("weight"))
            # A step reads its input twice; written each time, plans stay small.
            now = steps.store(now, "mix-step")
            steps.drop(*([last] if last is not None else []))
            last = now
    steps.drop(*wanted.values())
    return now


def mix(docs: DataFrame, targets: Mapping = TARGETS, topics: Mapping[str, str] = TOPICS, rate: float = RATE, rounds: int = ROUNDS,
        prefix: str = "_") -> DataFrame:
    """All documents with source, lang, topic, tokens, probability and kept beside their own columns.

    Their names begin with ``free_prefix(docs, prefix)``, so no column of ``docs`` is touched.
    """
    prefix = free_prefix(docs, prefix)
    rows = described(docs, topics, prefix)
    own = [f"{prefix}{d}" for d in DIMENSIONS]
    with Steps(docs.sparkSession) as steps:
        cells = steps.store(rows.groupBy(*own).agg(F.sum(f"{prefix}tokens").cast("double").alias("mass")).select(
            *(F.col(c).alias(d) for c, d in zip(own, DIMENSIONS)), "mass").where("mass > 0"), "mix-cells")
        raked = rake(cells, targets, rate, rounds, steps)
    chance = raked.select(
        *(F.col(d).alias(c) for c, d in zip(own, DIMENSIONS)), (F.col("weight") / F.col("mass") * F.lit(rate)).alias(f"{prefix}p"))
    name = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    drawn = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    return rows.join(chance, own, "left").withColumn(
        f"{prefix}probability", F.coalesce(f"{prefix}p", F.lit(rate))).withColumn(
        f"{prefix}kept", drawn < F.col(f"{prefix}probability")).drop(f"{prefix}p")


def mix_sql(targets: Mapping = TARGETS, topics: Mapping[str, str] = TOPICS, rate: float = RATE, rounds: int = ROUNDS) -> str:
    """The same in SQL, round by round, for exponents as targets."""
    cases = " ".join(f"WHEN regexp_matches(x, '{pattern}') THEN '{name}'" for name, pattern in topics.items())
    steps = [f"""WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         CASE {cases} ELSE 'prose' END AS topic, len(regexp_extract_all(x, '{WORDS}')) AS tokens
  FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS mass, CAST(sum(tokens) AS DOUBLE) AS weight
  FROM d GROUP BY ALL HAVING sum(tokens) > 0)"""]
    for dim in DIMENSIONS:
        steps.append(f"""g_{dim} AS MATERIALIZED (SELECT {dim}, power(m, {targets[dim]}) / (sum(power(m, {targets[dim]})) OVER ()) * (sum(m) OVER ()) AS goal
  FROM (SELECT {dim}, sum(mass) AS m FROM c0 GROUP BY {dim}))""")
    last = 0
    for _ in range(rounds):
        for dim in DIMENSIONS:
            steps.append(f"""c{last + 1} AS MATERIALIZED (SELECT source, lang, topic, mass, least(weight * goal / sum(weight) OVER (PARTITION BY {dim}), mass / {rate}) AS weight
  FROM c{last} JOIN g_{dim} USING ({dim}))""")
            last += 1
    return ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(p, 6) AS probability,
       CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'none')), 1, 13) AS BIGINT) AS DOUBLE) / {float(2**52)!r} < p AS kept
FROM (SELECT d.*, coalesce(weight / mass * {rate}, {rate}) AS p FROM d LEFT JOIN c{last} USING (source, lang, topic))"""
