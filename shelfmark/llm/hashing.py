"""Embedding near-duplicates: codes from iterative quantisation, multi-index Hamming tables, exact cosine afterwards.

1. Equal vectors are one class, so copies cost one row each and no pairs.
2. Rotations are learned on at most ``sample`` classes, taken by a hash of their id: a projection to principal components, balanced
   by turns of sign codes and orthogonal fits (Gong and Lazebnik, 2011). Several start from different random rotations, to give ``tables * key_bits``
   bits in all. Every vector is coded.
3. Each table is keyed by ``key_bits`` bits of the code. Vectors with an equal key in some table are compared with their
   original values, in double precision. A pair counts in the first table that it shares.
4. A key held by many vectors is compared in blocks: pairs of blocks are dealt to tasks, so no bucket is capped and none
   is gathered whole. A task returns one row per vector with links: their number, and the smallest id it reaches.

Work per table grows with rows squared over 2 ** key_bits: add two bits for every four times as many rows. With 16 tables of 12
bits a pair at cosine 0.98 is found almost surely, one at exactly 0.9 with probability 0.93.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing. Only
vectors of one length are compared. Rows that share an id are one node; null ids are not linked, and kept. A row's links
count the rows other than itself. Other columns, labels too, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import components, pieces_of, store
from shelfmark.llm.neardup import forest


def rotation(rows: np.ndarray, seed: int, turns: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection that give balanced sign codes of ``rows``."""
    mean = rows.mean(axis=0)
    centred = rows - mean
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(rows.shape[1]))
    reduced = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((rows.shape[1],) * 2))
    for _ in range(turns):
        code = np.where(reduced @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(reduced.T @ code)
        turn = left @ right
    return mean, axes @ turn


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def learn(vectors: pd.DataFrame, bits: int) -> dict[int, list]:
    """Rotations by vector length, as many as ``bits`` need."""
    out = {}
    length = vectors["v"].map(len)
    for d in sorted(set(length)):
        rows = unit(np.stack([np.asarray(v, np.float64) for v in vectors["v"][length == d]]))
        out[int(d)] = [rotation(rows, seed) for seed in range(-(-bits // d))]
    return out


def coder(learned: dict[int, list], tables: int, key_bits: int):
    weights = 1 << np.arange(key_bits)

    def run(frames):
        for frame in frames:
            length = frame["v"].map(len).to_numpy()
            parts = []
            for d in np.unique(length):
                part = frame[length == d]
                rows = unit(np.stack([np.asarray(v, np.float64) for v in part["v"]]))
                turns = learned.get(int(d)) or [rotation(np.eye(d), seed) for seed in range(-(-tables * key_bits // int(d)))]
                code = np.concatenate([(rows - mean) @ turn >= 0 for mean, turn in turns], axis=1)[:, :tables * key_bits]
                keys = (code.reshape(len(part), tables, key_bits) * weights).sum(axis=2)
                parts.append(pd.DataFrame({"rep": part["rep"], "n": part["n"], "d": int(d), "v": part["v"],
                                           "keys": list(keys.astype(np.int32))}))
            if parts:
                yield pd.concat(parts)
    return run


def linker(least: float):
    """Per vector of a cell with links: how many rows it links with, and the smallest id it reaches."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = part.reset_index(drop=True)
        all_ids, all_n, all_blocks = (part[c].to_numpy() for c in ("rep", "n", "block"))
        all_keys = np.stack(list(part["keys"]))
        vectors = list(part["v"])
        for (_, t, _, i, j), at in part.groupby(["d", "t", "key", "i", "j"], sort=False).indices.items():
            if len(at) < 2:
                continue
            rows = unit(np.stack([vectors[x] for x in at]).astype(np.float64))
            ids, weight, block = all_ids[at], all_n[at], all_blocks[at]
            a, b = (np.flatnonzero(block == x) for x in (i, j))
            x, y = np.nonzero(rows[a] @ rows[b].T >= least)
            x, y = a[x], b[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            if t and len(x):
                keys = all_keys[at, :t]
                first = np.ones(len(x), bool)
                for s in range(t):
                    first &= keys[x, s] != keys[y, s]
                x, y = x[first], y[first]
            if not len(x):
                continue
            links = np.bincount(x, weight[y], len(at)) + np.bincount(y, weight[x], len(at))
            order = np.argsort(ids, kind="stable")
            back = np.argsort(order)
            near = np.zeros((len(at), len(at)), bool)
            near[back[x], back[y]] = near[back[y], back[x]] = True
            reach = np.arange(len(at))
            for node, low in forest(near):
                reach[node] = low
            hit = np.flatnonzero(links)
            out.append(pd.DataFrame({"id": ids[hit], "links": links[hit].astype(np.int64), "low": ids[order[reach[back[hit]]]]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "links": [], "low": []}, dtype=np.int64)
    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, tables: int = 16, key_bits: int = 12, sample: int = 4096,
                 block: int = 512, group_bytes: int = 8 << 20) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs found with cosine of at least ``least``."""
    kind = vectors.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(kind, T.FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    sound = F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        & F.exists("v", lambda c: c != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    classes = store(rows.where(sound).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "near-classes")
    # At most ``sample`` vectors come to the driver, to learn the rotations from.
    taken = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toPandas()
    learned = learn(taken, tables * key_bits)
    coded = store(classes.mapInPandas(coder(learned, tables, key_bits), f"rep long, n long, d int, v array<{kind}>, keys array<int>"),
                  "near-codes")
    spread = coded.select("*", F.posexplode("keys").alias("t", "key"))
    # One row per length, table and key: a number of rows that does not grow with the vectors.
    sizes = coded.select("d", F.posexplode("keys").alias("t", "key")).groupBy("d", "t", "key").agg(F.count("*").alias("size"))
    dealt = spread.join(sizes.where("size > 1"), ["d", "t", "key"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    total = coded.agg(F.sum(F.col("d").cast("long"))).first()[0] or 0
    cells = dealt.select("rep", "n", "d", "v", "keys", "t", "key", "block", F.least("block", "o").alias("i"),
                         F.greatest("block", "o").alias("j"))
    cells = cells.withColumn("g", F.pmod(F.xxhash64("d", "t", "key", "i", "j"), F.lit(pieces_of(total * 8 * tables, group_bytes))))
    found = store(cells.groupBy("g").applyInPandas(linker(least), "id long, links long, low long"), "near-found")
    linked = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    facts = classes.select(F.col("v").alias("_v"), "rep", "n").join(
        counts.withColumnRenamed("id", "rep"), "rep", "left").join(
        linked.withColumnRenamed("id", "rep"), "rep", "left")
    usable = rows.withColumn("_key", F.when(sound, F.col("v")))
    joined = usable.join(facts, usable["_key"] == facts["_v"], "left")
    own = F.coalesce("component", "rep", "vec_id")
    return joined.select(
        "vec_id", F.when(F.col("rep").isNull(), F.lit(0)).otherwise(
            F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
