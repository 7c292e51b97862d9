"""Exact inner-product search by columnar branch and bound.

Vectors lie in blocks, dimension after dimension. For a query, partial products are accumulated a few dimensions at a time,
those with most of the query's mass first. What the remaining dimensions can still add is bounded by
Cauchy-Schwarz from the mass that is left on both sides; rows whose upper bound is below the k-th best lower bound are
dropped and the others compacted before the next dimensions are read. Every row meets every query: blocks of rows are dealt
to blocks of queries by an equi-join on the block number, and only k rows per query and block leave a task.

Vectors with a component beyond 2**28 after scaling lie in blocks of their own, as doubles; every pair with one of them is computed
in whole numbers of any length.

Defined results: a vector that is null or empty, or has a null or non-finite component, takes no part, as query and as row. A best score
that does not fit into 64 bits is an error. Only vectors of one length are compared. Repeated rows are rows of their own; a query
id that repeats asks once. Rows with the query's own id are left out; null ids take no part. Ties go to the smaller id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import pieces_of, store

LIMIT = 2**28
STEP = 8


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v, w): whole-number vectors of the rows that take part; beyond LIMIT, v is null and w has them before rounding down."""
    x = F.expr("transform(embedding, x -> cast(x as double))")
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & (F.size("x") > 0)
        & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= sys.float_info.max)))
    narrow = F.forall("x", lambda c: F.abs(c) <= LIMIT / scale)
    return fit.select("vec_id", F.when(narrow, F.expr(f"transform(x, c -> cast(floor({scale} * c) as int))")).alias("v"),
                      F.when(~narrow, F.expr(f"transform(x, c -> {scale}D * c)")).alias("w"))


def _pack(part: pd.DataFrame) -> Iterator[tuple[int, bool, bytes, bytes]]:
    """Blocks of one vector length, wide vectors apart: (length, wide, ids, components by dimension)."""
    all_ids = part["vec_id"].to_numpy()
    wide = part["v"].isna().to_numpy()
    for apart, column, kind in ((False, "v", np.int32), (True, "w", np.float64)):
        ids, rows = all_ids[wide == apart], list(part[column][wide == apart])
        length = np.array([len(r) for r in rows], np.int64)
        for d in np.unique(length):
            at = np.flatnonzero(length == d)
            matrix = np.floor(np.stack([np.asarray(rows[i], np.float64) for i in at])).astype(kind)
            yield int(d), apart, ids[at].astype(np.int64).tobytes(), np.ascontiguousarray(matrix.T).tobytes()


def row_blocks(each: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), each):
                part = frame.iloc[start:start + each]
                yield pd.DataFrame(list(_pack(part)), columns=["d", "wide", "ids", "block"])
    return run


def query_block(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("vec_id", kind="stable").drop_duplicates("vec_id")
    return pd.DataFrame([(int(part["q"].iloc[0]), *p) for p in _pack(part)], columns=["q", "d", "query_wide", "query_ids", "query_block"])


def best_of_block(query: np.ndarray, own: int, columns: np.ndarray, mass: np.ndarray, ids: np.ndarray, k: int):
    """Indexes and scores of the k best rows of a block for one query."""
    steps = [slice(s, s + STEP) for s in range(0, len(query), STEP)]
    weights = np.array([float(np.square(query[s], dtype=np.float64).sum()) for s in steps])
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), columns.dtype)
    left, left_query = mass.sum(axis=0)[alive], weights.sum()
    for b in np.argsort(-weights, kind="stable"):
        score += query[steps[b]] @ columns[steps[b]][:, alive]
        left = left - mass[b, alive]
        left_query -= weights[b]
        if len(alive) > k:
            rest = np.sqrt(np.maximum(left, 0) * max(left_query, 0)) * (1 + 1e-9) + 1
            low = np.partition(score - rest, len(alive) - k)[len(alive) - k]
            keep = score + rest >= low
            if not keep.all():
                alive, score, left = alive[keep], score[keep], left[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return alive[order], score[order]


def best_of_wide_block(query: np.ndarray, own: int, columns: np.ndarray, ids: np.ndarray, k: int):
    """The same in Python's whole numbers."""
    alive = np.flatnonzero(ids != own)
    score = query @ columns[:, alive]
    order = np.array(sorted(range(len(alive)), key=lambda i: (-score[i], ids[alive[i]]))[:k], np.int64)
    return alive[order], score[order]


def whole_numbers(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, object)
    out.flat = [int(x) for x in values.flat]
    return out


def search_blocks(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                ids, query_ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.query_ids, np.int64)
                columns = np.frombuffer(r.block, np.float64 if r.wide else np.int32).reshape(r.d, -1)
                queries = np.frombuffer(r.query_block, np.float64 if r.query_wide else np.int32).reshape(r.d, -1).T
                if r.wide or r.query_wide:
                    columns = whole_numbers(columns)
                    found = []
                    for q, own in zip(whole_numbers(queries), query_ids):
                        at, score = best_of_wide_block(q, own, columns, ids, k)
                        found.append((np.full(len(at), own), ids[at], score.astype(np.int64)))
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))
                    continue
                most = max(int(np.abs(columns).max()), int(np.abs(queries).max()))
                # Products and sums of whole numbers are exact in doubles up to 2**53.
                kind = np.float64 if most * most * r.d < 2**52 else np.int64
                columns, queries = columns.astype(kind), np.ascontiguousarray(queries.astype(kind))
                mass = np.stack([np.square(columns[s:s + STEP], dtype=np.float64).sum(axis=0) for s in range(0, r.d, STEP)])
                found = []
                for q, own in zip(queries, query_ids):
                    at, score = best_of_block(q, own, columns, mass, ids, k)
                    found.append((np.full(len(at), own), ids[at], score.astype(np.int64)))
                parts = [np.concatenate(x) for x in zip(*found)]
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts)))
    return run


def top_k(vectors: DataFrame, asks, k: int = 5, scale: int = 256, rows_each: int = 4096, queries_each: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each row where column ``asks`` holds."""
    rows = scaled(vectors, scale)
    wanted = store(rows.where(asks), "topk-queries")
    groups = pieces_of(wanted.count(), queries_each)
    blocks = rows.mapInPandas(row_blocks(rows_each), "d int, wide boolean, ids binary, block binary")
    queries = (wanted.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
               .groupBy("q").applyInPandas(query_block, "q int, d int, query_wide boolean, query_ids binary, query_block binary"))
    dealt = blocks.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(queries, ["q", "d"])
    best = dealt.mapInPandas(search_blocks(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
