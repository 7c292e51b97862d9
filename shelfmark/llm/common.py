"""What several operators share: stored steps, connected components, bitmaps of keys, batches of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import Steps, store

LAST = 2**63 - 1  # where a null id stands in the order of ids


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces_of(total: int, each: int) -> int:
    """How many tasks or groups hold ``total`` when one holds about ``each``."""
    return max(1, -(-int(total) // each))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component) per id in an edge, component the smallest id reached.

    Rounds of large-star and small-star (Kiveris et al. 2014): both keep the components and move every edge towards
    the smallest id, until the edges are stars around it. A hub's neighbours are rows, never a list; the minimum is
    combined before the shuffle. Every round is written to the shared folder.
    """
    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    flat = store(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = digest(flat)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        # The minima are dealt anew before they are joined: both sides then are plain exchanges, which adaptive execution
        # splits where an id has very many neighbours.
        both = flat.union(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).hint("rebalance")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low.hint("rebalance"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        flat = store(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = digest(flat)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return flat.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        flat.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


class Bitmap:
    """A filter over hashed keys of fixed size (2 MB): never misses a key of ``df``, and lets some others through.

    It thins out texts before they are shuffled to an exact join; however full it gets, the join decides.
    """

    BITS = 24

    def __init__(self, df: DataFrame, key: str, hashed: bool = False) -> None:
        """``hashed``: the key is a hash already, and its low bits are taken as they are."""
        slot = F.col(key).bitwiseAND((1 << self.BITS) - 1) if hashed else self.slot(F.col(key))
        words = (df.select(slot.alias("s"))
                 .groupBy(F.shiftright("s", 6).cast("int").alias("w"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toPandas())
        bits = np.zeros(1 << (self.BITS - 6), np.int64)
        bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
        self.shared = df.sparkSession.sparkContext.broadcast(bits.tobytes())

    @classmethod
    def slot(cls, key):
        return F.pmod(F.xxhash64(key), F.lit(1 << cls.BITS)).cast("long")

    @staticmethod
    def has(bits: bytes, slots: np.ndarray) -> np.ndarray:
        words = np.frombuffer(bits, np.int64)
        return (words[slots >> 6] >> (slots & 63)) & 1 == 1


def text_runs(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """UTF-8 texts in runs of about ``most`` bytes, with the index of the first; a longer text is a run of its own."""
    run: list[bytes] = []
    size = start = 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and size + len(data) > most:
            yield start, run
            run, size, start = [], 0, i
        run.append(data)
        size += len(data)
    if run:
        yield start, run


# ---- hashes of all substrings, by numpy

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
BYTE_CODE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the base and of its inverse modulo 2**64, made longer when asked for."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16, min(2 * self.n, 1 << 23))
            self.up, self.down = (np.full(self.n, x, np.uint64) for x in (BASE, INVERSE))
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Prefixes:
    """Prefix sums that give the polynomial hash of any stretch of ``codes`` (uint64) in constant time."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = POWERS.get(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def arrow(schema: dict, **columns) -> pa.RecordBatch:
    """A batch with the named types, from lists or arrays; None is null, and whole numbers stay whole."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], type=kind) for name, kind in schema.items()], names=list(schema))
