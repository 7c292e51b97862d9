"""An inverted index of character trigrams, so that a substring search reads the bodies of candidates only.

The index is a folder of tables.

* ``docs``: the files table as it came, in blocks of rows, one folder per block. A row is known by its block and its place in it.
* ``postings``: (gram, block, places): the places of the rows that hold a gram in any searched field. Ordered by gram and
  kept in folders by its first character, so that a search opens few of them; a list never covers more than one block.
* ``grams``: (gram, n): how many rows hold it.
* ``columns``: no rows; the columns of the files table, which folders without rows don't tell.

A gram is three code points in one number; behind the end of a field it is filled up with zeros, so a term of one or two
characters is the range of grams that begin with it.

A search takes the rarest grams of every term, meets their places, and so knows a superset of the matching rows. ``rows`` gives
those rows of the files table, and the searches of ``search`` run on them as they run on the whole table: what they find,
their scores and totals are the same. The rarest gram bounds the number of candidates before anything is read. Up to
``broadcast_rows`` they are sent to the scan, which then opens only blocks that hold one; beyond that the whole table is scanned,
as a search for something so common would read most of it anyway.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from shelfmark.functions.text import any_true
from shelfmark.operators import search
from shelfmark.policy import SEARCH_SCOPES, Policy

BITS = 21  # of a code point
END = "\x00"  # behind a field
LEADS = 256  # folders of postings
PIECE = 1 << 20  # characters that are turned into postings at once


def gram_codes(term: str) -> list[tuple[int, int]]:
    """The ranges of grams, first and last, that a text with this term holds; one for a term of up to three characters."""
    points = [ord(c) for c in term]
    if len(points) < 3:
        low = sum(p << BITS * (2 - i) for i, p in enumerate(points))
        return [(low, low + (1 << BITS * (3 - len(points))) - 1)]
    codes = [points[i] << 2 * BITS | points[i + 1] << BITS | points[i + 2] for i in range(len(points) - 2)]
    return [(c, c) for c in dict.fromkeys(codes)]


def lead(gram: Column) -> Column:
    return F.pmod(F.shiftright(gram, 2 * BITS), F.lit(LEADS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece of rows of one block: the sorted places of every gram."""
    for batch in batches:
        blocks, places = batch.column("block").to_numpy(), batch.column("place").to_numpy()
        column, rows = batch.column("text"), batch.num_rows
        lengths = pc.utf8_length(column).to_numpy()
        start = 0
        while start < rows:
            stop, size = start, 0
            while stop < rows and blocks[stop] == blocks[start] and (stop == start or size + lengths[stop] <= PIECE):
                size, stop = size + lengths[stop] + 3, stop + 1
            # Only the texts of one piece are Python's at a time, and rows stand in order, so equal grams keep theirs.
            texts = column.slice(start, stop - start).to_pylist()
            data = np.frombuffer((END * 2).join([*texts, "", ""]).encode("utf-32-le", "surrogatepass"), "<u4")
            del texts
            row = np.repeat(np.arange(stop - start, dtype=np.int32), lengths[start:stop] + 2)
            codes = data[:len(row)].astype(np.int64)
            held = codes != 0
            for following in (data[1:len(row) + 1], np.where(data[1:len(row) + 1] == 0, 0, data[2:len(row) + 2])):
                codes <<= BITS
                codes |= following
            codes, row = codes[held], row[held]
            order = np.argsort(codes, kind="stable")
            codes, row = codes[order], row[order]
            fresh = np.ones(len(codes), bool)
            fresh[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
            codes, row = codes[fresh], row[fresh]
            edge = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(codes)), pa.int32()),
                                             pa.array(places[start:stop][row], pa.int32())) if len(edge) else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[edge], pa.int64()), pa.array(np.full(len(edge), blocks[start]), pa.int64()), lists], names=["gram", "block", "places"])
            start = stop


class GramIndex:
    """A files table with its index, under one folder."""

    def __init__(self, spark: SparkSession, path: str, most_grams: int = 4, broadcast_rows: int = 100_000) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.most_grams, self.broadcast_rows = most_grams, broadcast_rows

    @classmethod
    def build(cls, files: DataFrame, path: str, rows_per_block: int = 1 << 16, **settings) -> GramIndex:
        """Store ``files`` and its index. Rows stay in the tasks that read them; only postings are shuffled."""
        out = cls(files.sparkSession, path, **settings)
        bits = rows_per_block.bit_length() - 1
        if rows_per_block != 1 << bits or bits > 24:
            raise ValueError("rows_per_block must be a power of two, at most 2 ** 24")
        files.limit(0).write.parquet(f"{out.path}/columns")
        number = F.monotonically_increasing_id()
        files.withColumn("_number", number).withColumns({
            "block": F.shiftright("_number", bits), "place": F.col("_number").bitwiseAND(rows_per_block - 1).cast("int"),
        }).drop("_number").write.partitionBy("block").parquet(f"{out.path}/docs")
        fields = [search.field(f) for f in SEARCH_SCOPES["all"]]
        texts = out.docs().select("block", "place", F.concat_ws(END * 2, *fields).alias("text"))
        found = texts.mapInArrow(_postings, "gram long, block long, places array<int>").withColumn("lead", lead(F.col("gram")))
        found.repartitionByRange("lead", "gram", "block").sortWithinPartitions("lead", "gram", "block").write.partitionBy("lead").parquet(
            f"{out.path}/postings")
        counts = out.postings().groupBy("lead", "gram").agg(F.sum(F.size("places")).alias("n"))
        counts.repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram").write.partitionBy("lead").parquet(f"{out.path}/grams")
        return out

    def docs(self) -> DataFrame:
        """The files table, with ``block`` and ``place``."""
        kept = self.spark.read.parquet(f"{self.path}/columns").schema
        kind = StructType([*kept.fields, StructField("place", IntegerType()), StructField("block", LongType())])
        return self.spark.read.schema(kind).parquet(f"{self.path}/docs")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram long, block long, places array<int>, lead int").parquet(f"{self.path}/postings")

    def grams(self) -> DataFrame:
        return self.spark.read.schema("gram long, n long, lead int").parquet(f"{self.path}/grams")

    @staticmethod
    def _within(ranges: Sequence[tuple[int, int]]) -> Column:
        leads = sorted({(low >> 2 * BITS) % LEADS for low, _ in ranges})
        single = sorted({low for low, high in ranges if low == high})
        wide = [F.col("gram").between(low, high) for low, high in ranges if low != high]
        return F.col("lead").isin(leads) & any_true(([F.col("gram").isin(single)] if single else []) + wide)

    def choose(self, terms: Sequence[str]) -> tuple[list[tuple[int, int]], int]:
        """The rarest grams of every term, and the most rows that can hold all of them.

        One small read: a row per gram of the query. A term shorter than a gram counts as one that any row may hold.
        """
        ranges = {r: None for t in terms for r in gram_codes(t)}
        single = [r for r in ranges if r[0] == r[1]]
        known = {}
        if single:
            known = {r.gram: r.n for r in self.grams().where(self._within(single)).select("gram", "n").collect()}
        chosen: dict[tuple[int, int], int | None] = {}
        for term in terms:
            own = gram_codes(term)
            if own[0][0] != own[0][1]:
                chosen[own[0]] = None
                continue
            for r in sorted(own, key=lambda r: known.get(r[0], 0))[:self.most_grams]:
                chosen[r] = known.get(r[0], 0)
        bounds = [n for n in chosen.values() if n is not None]
        # Grams that every mask can hold; the rarest come first, and each that is left out only leaves more candidates.
        kept = sorted(chosen, key=lambda r: (chosen[r] is None, chosen[r] or 0))[:60]
        return kept, min(bounds) if bounds else 1 << 62

    def candidates(self, ranges: Sequence[tuple[int, int]]) -> DataFrame:
        """(block, place) of the rows that hold a gram of every range."""
        bit = F.lit(0).cast("long")
        for i, (low, high) in enumerate(ranges):
            bit = bit.bitwiseOR(F.when(F.col("gram").between(low, high), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        held = self.postings().where(self._within(ranges)).select("block", bit.alias("bits"), F.explode("places").alias("place"))
        return held.groupBy("block", "place").agg(F.bit_or("bits").alias("bits")).where(F.col("bits") == (1 << len(ranges)) - 1).select(
            "block", "place")

    def rows(self, terms: Sequence[str]) -> DataFrame:
        """The files that can hold all terms (in lower case): all that do, and few others."""
        docs = self.docs()
        columns = [c for c in docs.columns if c not in ("block", "place")]
        terms = [t for t in terms if t and END not in t]  # the others are left to the search itself
        if not terms:
            return docs.select(*columns)
        ranges, most = self.choose(terms)
        if not most:
            return docs.select(*columns).limit(0)
        if most > self.broadcast_rows:
            return docs.select(*columns)
        # At most ``broadcast_rows`` pairs of numbers; the scan opens the folders of their blocks only.
        return docs.join(F.broadcast(self.candidates(ranges)), ["block", "place"], "left_semi").select(*columns)

    def search_files(self, query: str, policy: Policy, **options) -> DataFrame:
        return search.search_files(self.rows(search.terms_of(query)), query, policy, **options)

    def search_total(self, query: str, policy: Policy, **options) -> DataFrame:
        return search.search_total(self.rows(search.terms_of(query)), query, policy, **options)

    def search_keyword(self, keyword: str, policy: Policy, **options) -> DataFrame:
        return search.search_keyword(self.rows([keyword.strip().lower()]), keyword, policy, **options)

    def search_simple(self, keyword: str, limit: int | None = None) -> DataFrame:
        return search.search_simple(self.rows([keyword.strip().lower()]), keyword, limit)
