"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of words. Lines with equal words are copies; lines of at least ``least_words`` words are near when one word
put in, taken out or exchanged makes them equal. A line goes if an earlier document, or an earlier line of its document,
has a copy; and all its copies go if an earlier line is near. Earlier means smaller document id, then line number; lines are
judged on the input, not on what is left. Lines without words stay.

1. Lines are hashed where they are read (128 bits); per distinct line only its first place moves.
2. Of two near lines one half is equal, whatever the edit. Hashes of halves, tagged with the length they stand for, find the
   lines that can have a near one at all, and on which side the edit lies. This loses no pair.
3. Only those send all variants with one word deleted there, as hashed keys, and themselves. Lines that share the same variant at the
   same place differ by an exchange there; a line that equals a variant differs by a deletion. Every line meets the earliest of its
   key, so a key with many lines gives no pairs.
4. Each such match is verified on the words themselves; the earliest line stays.

Texts are shuffled once, to meet the hashes of the lines to drop; a bitmap of fixed size keeps other texts out of step 3. Lines are
read from the texts again rather than stored for all rows. A row is named by its id and a hash of its text: rows that agree in
both lose the same lines, so the list of a row has each line once, however many rows share an id or have none.

Defined results: null text stays null; a null id stands after all others; rows that share an id are one place in the order, so lines
they have in common stay in both; a document left without any line that it had words in is dropped. ``n_chars``, if
there, follows the text; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import BYTE_CODE, LAST, Bitmap, Prefixes, Steps, arrow, fresh, mix, text_runs

SECOND = np.uint64(0x5851F42D4C957F2D)


class Lines:
    """The lines of a run of texts: where they lie, their words, and hashes of any stretch of words."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.end = np.flatnonzero(self.data == 10)
        self.start = np.append(0, self.end[:-1] + 1)
        self.doc = np.searchsorted(ends, self.start, side="right")
        first = np.searchsorted(self.start, np.append(0, ends[:-1]))
        self.number = np.arange(len(self.start)) - first[self.doc]
        blank = (self.data == 32) | (self.data - np.uint8(9) < 5)  # space, or one of the five bytes from 9 on
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        self.word_start, self.word_end = edge[0::2], edge[1::2]
        hashes = Prefixes(BYTE_CODE.take(self.data))
        word = mix(hashes.hash(self.word_start, self.word_end) ^ (self.word_end - self.word_start).astype(np.uint64))
        self.low, self.high = Prefixes(word), Prefixes(mix(word ^ SECOND))
        self.since = np.searchsorted(self.word_start, self.start)
        self.upto = np.searchsorted(self.word_start, self.end)
        self.words = self.upto - self.since

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hash of each line."""
        n = self.words.astype(np.uint64)
        return tuple(mix(p.hash(self.since, self.upto) ^ n).view(np.int64) for p in (self.low, self.high))

    def halves(self, least_words: int) -> list[np.ndarray]:
        """Hashes of the first and last half for lines of the line's length and of one word less; 0 where there is none."""
        out = []
        for m in (self.words, self.words - 1):
            fit = m >= least_words
            half = np.where(fit, m // 2, 0)
            tag = mix(np.maximum(m, 0).astype(np.uint64) * np.uint64(2))
            first = mix(self.low.hash(self.since, self.since + half) ^ tag)
            last = mix(self.low.hash(self.upto - np.where(fit, m - half, 0), self.upto) ^ tag ^ SECOND)
            out += [np.where(fit, x.view(np.int64), 0) for x in (first, last)]
        return out

    def line(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def first_of(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a line is the first of its kind in its document."""
    order = np.lexsort((np.arange(len(doc)), high, low, doc))
    same = (doc[order[1:]] == doc[order[:-1]]) & (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
    out = np.ones(len(doc), bool)
    out[order[1:][same]] = False
    return out


def places(docs: DataFrame, least_words: int) -> DataFrame:
    """One row per document and distinct line with words: hashes, first place, hashes of halves."""
    names = ("low", "high", "doc", "k0", "k1", "k2", "k3")
    kinds = {**{n: pa.int64() for n in names}, "number": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            for start, texts in text_runs(batch.column("text").to_pylist()):
                lines = Lines(texts)
                low, high = lines.names()
                take = np.flatnonzero(first_of(lines.doc, low, high) & (lines.words > 0))
                k = [x[take] for x in lines.halves(least_words)]
                yield arrow(kinds, low=low[take], high=high[take], doc=ids[start + lines.doc[take]], k0=k[0], k1=k[1], k2=k[2],
                            k3=k[3], number=lines.number[take].astype(np.int32))

    return docs.mapInArrow(run, "low long, high long, doc long, k0 long, k1 long, k2 long, k3 long, number int")


def lines_of(docs: DataFrame, wanted: Bitmap) -> DataFrame:
    """(low, high, doc, row): the distinct lines with words of each row whose hash may be in the bitmap."""
    kinds = {n: pa.int64() for n in ("low", "high", "doc", "row")}
    shared, mask = wanted.shared, (1 << Bitmap.BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for start, texts in text_runs(batch.column("text").to_pylist()):
                lines = Lines(texts)
                low, high = lines.names()
                take = np.flatnonzero(Bitmap.has(shared.value, low & mask) & (lines.words > 0))
                take = take[first_of(lines.doc[take], low[take], high[take])]
                at = start + lines.doc[take]
                yield arrow(kinds, low=low[take], high=high[take], doc=ids[at], row=row[at])

    return docs.mapInArrow(run, "low long, high long, doc long, row long")


def texts_of(docs: DataFrame, wanted: Bitmap, holders: Bitmap) -> DataFrame:
    """(low, high, doc, number, line) of the lines whose hash and document may be in the bitmap; ``holders`` has the documents alone."""
    kinds = {"low": pa.int64(), "high": pa.int64(), "doc": pa.int64(), "number": pa.int32(), "line": pa.binary()}
    shared, some, mask = wanted.shared, holders.shared, (1 << Bitmap.BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            batch = batch.filter(pa.array(Bitmap.has(some.value, ids & mask)))
            ids = batch.column("doc").to_numpy()
            for start, texts in text_runs(batch.column("text").to_pylist()):
                lines = Lines(texts)
                low, high = lines.names()
                doc = ids[start + lines.doc]
                take = np.flatnonzero(Bitmap.has(shared.value, (low ^ doc) & mask) & (lines.words > 0))
                yield arrow(kinds, low=low[take], high=high[take], doc=doc[take], number=lines.number[take].astype(np.int32),
                            line=[lines.line(i) for i in take])

    return docs.mapInArrow(run, "low long, high long, doc long, number int, line binary")


def halves_in(wanted: Bitmap):
    """(low, side, k) of the halves that may be in the bitmap."""
    kinds = {"low": pa.int64(), "side": pa.int32(), "k": pa.int64()}
    shared, mask = wanted.shared, (1 << Bitmap.BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column("low").to_numpy()
            for side in range(4):
                k = batch.column(f"k{side}").to_numpy()
                take = np.flatnonzero(Bitmap.has(shared.value, k & mask) & (k != 0))
                yield arrow(kinds, low=low[take], side=np.full(len(take), side, np.int32), k=k[take])
    return run


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashed keys of each line (at -1) and of the line without word ``at``, for the words on the side of the edit."""
    kinds = {"v0": pa.int64(), "v1": pa.int32(), "at": pa.int32(), "low": pa.int64(), "doc": pa.int64(), "number": pa.int32()}
    for batch in batches:
        cols = {n: batch.column(n).to_numpy() for n in ("low", "doc", "number", "sides")}
        raw = batch.column("line").to_pylist()
        start = 0
        while start < len(raw):
            size, stop = 0, start
            while stop < len(raw) and (stop == start or size + len(raw[stop]) < 1 << 18):
                size, stop = size + len(raw[stop]), stop + 1
            lines = Lines(raw[start:stop])
            sides, n = cols["sides"][start:stop], lines.words
            # Sides 1 and 4: the first half is shared, the edit lies behind it; 2 and 8: the last half is shared.
            behind = np.where(sides & 4, (n - 1) // 2, n // 2)
            before = np.where(sides & 8, n - (n - 1 - (n - 1) // 2), n - (n - n // 2))
            first = np.where(sides & 10, 0, behind)
            last = np.where(sides & 5, n, before)
            many = last - first + 1
            row = np.repeat(np.arange(stop - start), many)
            at = first[row] - 1 + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            whole = at < first[row]
            a, b = lines.since[row], lines.upto[row]
            cut = np.where(whole, 0, at)
            length = np.where(whole, n[row], n[row] - 1).astype(np.uint64)
            keys = []
            for p in (lines.low, lines.high):
                left, right = p.sums[a + cut] - p.sums[a], p.sums[b] - p.sums[np.minimum(a + cut + 1, b)]
                joined = left * p.down[a] + right * p.down[np.minimum(a + 1, b)]
                keys.append(mix(np.where(whole, p.hash(a, b), joined) ^ length).view(np.int64))
            at[whole] = -1
            pick = {name: cols[name][start:stop][row] for name in ("low", "doc", "number")}
            keys[1] = keys[1].astype(np.int32)  # the low half: a key has 96 bits
            for s in range(0, len(row), 100_000):
                e = slice(s, s + 100_000)
                yield arrow(kinds, v0=keys[0][e], v1=keys[1][e], at=at[e].astype(np.int32),
                            **{name: value[e] for name, value in pick.items()})
            start = stop


def one_word_apart(a: bytes, b: bytes) -> bool:
    """Whether one word put in, taken out or exchanged makes two lines equal; equal lines are."""
    x, y = a.split(), b.split()
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    if len(x) == len(y):
        return x[i + 1:] == y[i + 1:]
    return x[i + 1:] == y[i:] if len(x) > len(y) else x[i:] == y[i + 1:]


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"low": pa.int64(), "high": pa.int64()}
    for batch in batches:
        near = [one_word_apart(a, b) for a, b in zip(batch.column("line").to_pylist(), batch.column("other").to_pylist())]
        batch = batch.filter(pa.array(near, pa.bool_()))
        yield arrow(kinds, low=batch.column("low"), high=batch.column("high"))


def near_lines(docs: DataFrame, distinct: DataFrame, steps: Steps) -> DataFrame:
    """(low, high) of the distinct lines that have an earlier near line, as a stored step."""
    # Half of the hash names a line here: two lines with the same half hash only make both candidates.
    halves = distinct.select(F.explode(F.array("k0", "k1", "k2", "k3")).alias("k")).where("k <> 0")
    shared = steps.store(halves.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "line-halves")
    held = distinct.select("low", "k0", "k1", "k2", "k3").mapInArrow(
        halves_in(Bitmap(shared, "k", hashed=True)), "low long, side int, k long")
    sides = held.join(shared, "k").groupBy("low").agg(F.bit_or(F.expr("shiftleft(1, side)")).alias("sides"))
    able = steps.store(distinct.select("low", "high", "doc", "number").join(sides, "low"), "line-candidates")
    steps.drop(shared)
    wanted = Bitmap(able.select(F.col("low").bitwiseXOR(F.col("doc")).alias("slot")), "slot", hashed=True)
    holders = Bitmap(able, "doc", hashed=True)
    # Rows with equal ids hold a line at the same place; one of them gives its words.
    lines = steps.store(texts_of(docs, wanted, holders).join(able, ["low", "high", "doc", "number"]).groupBy("low", "high", "doc", "number").agg(
        F.first("sides").alias("sides"), F.first("line").alias("line")), "line-texts")
    steps.drop(able)
    keys = steps.store(lines.mapInArrow(variants, "v0 long, v1 int, at int, low long, doc long, number int"), "line-keys")
    place = F.struct("doc", "number", "low")
    # The earliest line of each key: with the word at the same place deleted, whole, and with any word deleted.
    same = keys.where("at >= 0").groupBy("v0", "v1", "at").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    both = keys.groupBy("v0", "v1").agg(
        F.min(F.when(F.col("at") < 0, place)).alias("whole"), F.min(F.when(F.col("at") >= 0, place)).alias("cut"))
    earlier = lambda c: F.col(c) < place
    exchanged = keys.join(same.where("n > 1").drop("n"), ["v0", "v1", "at"]).where(earlier("first")).select(
        "low", "doc", "number", F.col("first").alias("other"))
    moved = keys.join(both.where("whole IS NOT NULL AND cut IS NOT NULL"), ["v0", "v1"]).select(
        "low", "doc", "number", F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole")).alias("other"))
    moved = moved.where(earlier("other"))
    pairs = exchanged.union(moved).select("low", "doc", "number", F.col("other.low").alias("low2"), F.col("other.doc").alias("doc2"),
                                          F.col("other.number").alias("number2")).distinct()
    other = lines.select(*(F.col(c).alias(f"{c}2") for c in ("low", "doc", "number")), F.col("line").alias("other"))
    held = pairs.join(lines.select("low", "high", "doc", "number", "line"), ["low", "doc", "number"]).join(other, ["low2", "doc2", "number2"])
    near = steps.store(held.select("low", "high", "line", "other").mapInArrow(verify, "low long, high long").distinct(), "line-near")
    steps.drop(lines, keys)
    return near


def may_repeat(text: str | None) -> bool:
    """False if no two lines of a text can have equal words: no two are equal without their blanks."""
    if text is None or "\n" not in text:
        return False
    filled = [x for x in text.encode("utf-8", "surrogatepass").translate(None, b"\t\v\f\r ").split(b"\n") if x]
    return len(set(filled)) < len(filled)


def cut_lines(told: str):
    """Texts without the lines whose hashes are listed in column ``told``, and without repeated lines.

    That column comes back as whether the document lost all lines that it had words in. Texts that can't lose a line are not hashed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lists = batch.column("text").to_pylist(), batch.column(told).to_pylist()
            gone = [False] * len(out)
            place = [i for i, text in enumerate(out) if text is not None and (lists[i] or may_repeat(text))]
            for start, texts in text_runs([out[i] for i in place]):
                at = place[start:start + len(texts)]
                lines = Lines(texts)
                low, high = lines.names()
                bad = [np.array(lists[i] or [], np.int64).reshape(-1, 2) for i in at]
                owner = np.repeat(np.arange(len(bad)), [len(b) for b in bad])
                bad = np.concatenate(bad)
                # A line that is listed, or stands earlier in the document, is not the first of its kind.
                name = np.concatenate([bad[:, 0], low]), np.concatenate([bad[:, 1], high])
                keep = first_of(np.concatenate([owner, lines.doc]), *name)[len(owner):] | (lines.words == 0)
                edge = np.searchsorted(lines.doc, np.arange(len(texts) + 1))
                for i, a, b in zip(at, edge[:-1], edge[1:]):
                    k = keep[a:b]
                    if not k.all():
                        out[i] = b"\n".join(lines.line(j) for j in a + np.flatnonzero(k)).decode("utf-8", "surrogatepass")
                        gone[i] = not (k & (lines.words[a:b] > 0)).any()
            new = {"text": pa.array(out, batch.schema.field("text").type), told: pa.array(gone, pa.bool_())}
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)
    return run


def drop_lines(docs: DataFrame, least_words: int = 8) -> DataFrame:
    """The documents, columns as they came, without lines that an earlier place has, exactly or but for one word."""
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.col("text").cast("string")
    texts = docs.select(key.alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    with Steps(docs.sparkSession) as steps:
        distinct = steps.store(places(texts, least_words).groupBy("low", "high").agg(
            F.min(F.struct("doc", "number")).alias("p"), F.max("doc").alias("last"), *(F.max(c).alias(c) for c in ("k0", "k1", "k2", "k3"))).select(
            "low", "high", F.col("p.doc").alias("doc"), F.col("p.number").alias("number"), "last", "k0", "k1", "k2", "k3"), "line-distinct")
        near = near_lines(texts, distinct, steps)
        # Only lines of several documents, or near earlier ones, go anywhere.
        judged = steps.store(distinct.select("low", "high", F.col("doc").alias("first"), "last").join(
            near.withColumn("near", F.lit(True)), ["low", "high"], "left").where("near OR first <> last").select(
            "low", "high", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-judged")
        steps.drop(distinct, near)
    # A plain join of what is read and what is stored, so that adaptive execution can split a line that very many documents have.
    bad = lines_of(texts, Bitmap(judged, "low", hashed=True)).join(judged, ["low", "high"]).where("near OR doc <> first")
    told, place, name = fresh(docs, "_told"), fresh(docs, "_place"), fresh(docs, "_row")
    drops = bad.groupBy(F.col("doc").alias(place), F.col("row").alias(name)).agg(F.collect_set(F.array("low", "high")).alias(told))
    rows = docs.withColumn("text", text).withColumns({place: key, name: F.xxhash64(text)}).join(drops, [place, name], "left").drop(place, name)
    schema = ", ".join(f"`{f.name}` {'boolean' if f.name == told else f.dataType.simpleString()}" for f in rows.schema.fields)
    done = rows.mapInArrow(cut_lines(told), schema).where(~F.col(told)).drop(told)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
