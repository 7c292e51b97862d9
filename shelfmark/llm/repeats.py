"""Repeated byte strings across documents: maximal repeats from the interval tree of an enhanced suffix array.

A byte goes if a string of ``least`` bytes that covers it also starts in a document with a smaller id. At scale the suffixes
must be dealt out so that equal strings meet, without moving every suffix:

1. Every string of ``least`` bytes names an anchor, the k bytes in it with the smallest hash. Neighbouring strings with one
   anchor form a stretch; equal strings always lie in stretches with equal anchors. Documents are read in chunks, and a
   chunk sends one entry per distinct stretch: hashes of anchor and stretch, and the smallest document there. Copies so
   become one leaf before anything is shuffled.
2. Entries meet by anchor. A stretch that an earlier document has as a whole is covered; that needs no bytes. Where
   one anchor has several stretches, the first holder of each sends its bytes, in parts.
3. Parts meet by core. A suffix array over all suffixes of at least ``least`` bytes, with its array of common
   prefixes, is scanned with a stack; intervals whose left extensions differ (or lie outside the stretch) are maximal
   repeats, and each gives all its occurrences. Occurrences in later documents than the first are covered.
4. The answers return to the chunks, where covered bytes are taken out.

A passage that many documents share in other surroundings gives its outer anchors one stretch per document. Such an anchor makes no large
group: where a chunk holds ``crowd`` stretches of an anchor it knows that they must be compared, and asks for two of them only; and bytes
do not meet by anchor but by cores. The strings of a stretch are dealt into four parts by where the anchor lies in them; all strings
of a part hold the same core, ``least`` bytes but seven or less, so equal strings have equal cores. A core leaves open seven bytes on
either side, and equal parts count once, so its group is as large as the number of different such surroundings.

Rows that travel are blobs per chunk and bucket. Hashes of 56 bits are only compared under equal anchors.

Defined results: null text is empty; a null id stands after all others; rows with equal ids (or null ids) do not cover each other;
texts shorter than ``least`` bytes stay whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import BYTE_CODE, LAST, Prefixes, Steps, arrow, mix, pieces_of, text_runs

CHUNK = 2 << 20
PARTS = 4
U8, U64 = np.uint8, np.uint64


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, nulls, ids, ends, data, bytes): texts end to end, compressed, with their ids."""
    kinds = {"chunk": pa.int64(), "nulls": pa.binary(), "ids": pa.binary(), "ends": pa.binary(), "data": pa.binary(),
             "bytes": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3)
        held_ids: list = []
        held: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            nothing = np.array([i is None for i in held_ids], bool)
            ids = np.array([LAST if i is None else i for i in held_ids], np.int64)
            return arrow(kinds, chunk=[number], nulls=[nothing.tobytes()], ids=[ids.tobytes()],
                         ends=[np.cumsum([len(t) for t in held], dtype=np.int64).tobytes()],
                         data=[pack.compress(b"".join(held))], bytes=[size])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, texts in text_runs(batch.column("text").to_pylist(), CHUNK // 4):
                held_ids += ids[start:start + len(texts)]
                held += texts
                size += sum(map(len, texts))
                if size >= CHUNK * 3 // 4:
                    yield row()
                    held_ids, held, size, number = [], [], 0, number + 1
        if held:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "chunk long, nulls binary, ids binary, ends binary, data binary, bytes long")


class Chunk:
    """A chunk's texts, its stretches in order of place, and its entries: distinct stretches in order of their hashes."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes, least: int, k: int, crowd: int) -> None:
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), U8)
        n = len(self.data)
        self.entries = 0
        if n < least:
            self.run_doc = self.start = self.end = self.entry = self.place = self.first = np.empty(0, np.int64)
            self.anchor = self.stretch = np.empty(0, U64)
            self.crowded = self.asked = np.empty(0, bool)
            return
        self.hashes = hashes = Prefixes(BYTE_CODE[self.data])
        grams = mix((hashes.sums[k:] - hashes.sums[:n - k + 1]) * hashes.down[:n - k + 1])
        bits = U64(max(n.bit_length(), 24))
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
        width, size = least - k + 1, 1
        while size * 2 <= width:
            low, size = np.minimum(low[:-size], low[size:]), size * 2
        if size < width:
            low = np.minimum(low[:size - width], low[width - size:])
        at = (low & ((U64(1) << bits) - U64(1))).astype(np.int32)
        doc = np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(self.ends, prepend=0))[:len(at)]
        inside = np.arange(least, least + len(at)) <= self.ends[doc]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(at)) - 1 + least
        whole = inside[start]
        start, end = start[whole], end[whole]
        self.start, self.end, self.run_doc = start, end, doc[start].astype(np.int64)
        self.place = at[start].astype(np.int64)
        anchor = grams[at[start]]
        stretch = mix(hashes.hash(start, end) ^ (end - start).astype(U64)) >> U64(8)
        order = np.lexsort((self.ids[self.run_doc], stretch, anchor))
        a, s = anchor[order], stretch[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(fresh) - 1
        lead = order[fresh]  # the stretch of the smallest document
        self.anchor, self.stretch, self.lead = a[fresh], s[fresh], lead
        self.first = self.ids[self.run_doc[lead]]
        self.entries = len(lead)
        # Crowded anchors of several documents: only the entries of the smallest and the largest document ask.
        edge = np.flatnonzero(np.append(True, self.anchor[1:] != self.anchor[:-1])) if len(lead) else np.empty(0, np.int64)
        size = np.diff(np.append(edge, len(lead)))
        order = np.lexsort((self.first, np.repeat(np.arange(len(edge)), size)))
        low, high = order[edge], order[edge + size - 1]
        crowded = (size >= crowd) & (self.first[low] < self.first[high])
        self.crowded = np.repeat(crowded, size)
        self.asked = ~self.crowded
        self.asked[low[crowded]] = self.asked[high[crowded]] = True

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Entries that ask, by the bucket of their anchor, in order."""
        bucket = ((self.anchor >> U64(32)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        order = order[self.asked[order]]
        edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        for s, e in zip(edge, np.append(edge[1:], len(order))):
            if e > s:
                yield int(bucket[order[s]]), order[s:e]

    def parts(self, entries: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
        """Parts of the entries' stretches: entry, start, end, and hash of the core; places are those of the chunk."""
        span = least - k + 1
        width = -(-span // PARTS)
        lead = self.lead[entries]
        start, end, anchor = self.start[lead], self.end[lead], self.place[lead]
        out = []
        for q in range(PARTS):
            near, far = q * width, min(q * width + width, span) - 1  # how far strings of this part may start before the anchor
            last = np.maximum(near, anchor - (end - least))
            first = np.minimum(far, anchor - start)
            some = np.flatnonzero(first >= last)
            place = anchor[some]
            core = mix(self.hashes.hash(place - near, place - far + least) ^ U64(q + 1))
            out.append((entries[some], place - first[some], place - last[some] + least, core))
        return tuple(np.concatenate(x) for x in zip(*out))


def planes(values: np.ndarray, keep: int) -> bytes:
    """The ``keep`` low bytes of 64-bit numbers, byte by byte: planes that are the same compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(U8).reshape(-1, 8)[:, :keep].T).tobytes()


def unplanes(data: bytes, keep: int) -> np.ndarray:
    raw = np.frombuffer(data, U8).reshape(keep, -1)
    out = np.zeros((raw.shape[1], 8), U8)
    out[:, :keep] = raw.T
    return out.view("<u8").ravel()


def sign(least: int, k: int, crowd: int, buckets: int):
    kinds = {"chunk": pa.int64(), "bucket": pa.int32(), "anchors": pa.binary(), "stretches": pa.binary(), "docs": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["ids"], r["ends"], r["data"], least, k, crowd)
                rows = [(b, planes(c.anchor[e], 4), planes(c.stretch[e], 7), planes(c.first[e], 8))
                        for b, e in c.by_bucket(buckets)]
                if rows:
                    b, a, s, d = zip(*rows)
                    yield arrow(kinds, chunk=[r["chunk"]] * len(b), bucket=b, anchors=a, stretches=s, docs=d)
    return run


def decide(part: pd.DataFrame) -> pd.DataFrame:
    """Per entry of a bucket: 1 if an earlier document has the whole stretch, 2 if its bytes must be compared, else 0."""
    anchor = np.concatenate([unplanes(x, 4) for x in part["anchors"]])
    stretch = np.concatenate([unplanes(x, 7) for x in part["stretches"]])
    doc = np.concatenate([unplanes(x, 8) for x in part["docs"]]).view(np.int64)
    order = np.lexsort((doc, stretch, anchor))
    a, s, d = anchor[order], stretch[order], doc[order]
    new_anchor = np.append(True, a[1:] != a[:-1])
    new_stretch = new_anchor | np.append(True, s[1:] != s[:-1])
    of_stretch, of_anchor = np.cumsum(new_stretch) - 1, np.cumsum(new_anchor) - 1
    leads = np.flatnonzero(new_stretch)
    first = d[leads][of_stretch]
    lowest, highest = (f.reduceat(d, np.flatnonzero(new_anchor)) for f in (np.minimum, np.maximum))
    several = (np.bincount(of_anchor[leads]) > 1) & (lowest < highest)
    code = np.where(d > first, 1, np.where(several[of_anchor], 2, 0)).astype(U8)
    back = np.empty(len(code), U8)
    back[order] = code
    ends = np.cumsum([len(x) // 4 for x in part["anchors"]])
    return pd.DataFrame({"chunk": part["chunk"], "bucket": part["bucket"],
                         "codes": [back[e - len(x) // 4:e].tobytes() for e, x in zip(ends, part["anchors"])]})


def codes_of(c: Chunk, answers: list, buckets: int) -> np.ndarray:
    code = np.where(c.crowded, 2, 0).astype(U8)
    told = {x["bucket"]: x["codes"] for x in answers or []}
    for b, e in c.by_bucket(buckets) if c.entries else ():
        code[e] = np.frombuffer(told[b], U8)
    return code


def send(least: int, k: int, crowd: int, buckets: int):
    """The bytes of the stretches that must be compared, in parts, by core."""
    kinds = {"chunk": pa.int64(), "bucket": pa.int32(), "entries": pa.binary(), "shifts": pa.binary(), "docs": pa.binary(),
             "cores": pa.binary(), "lengths": pa.binary(), "data": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["ids"], r["ends"], r["data"], least, k, crowd)
                entry = np.flatnonzero(codes_of(c, r["answers"], buckets) == 2)
                if not len(entry):
                    continue
                entry, start, end, core = c.parts(entry, least, k)
                bucket = ((core >> U64(32)) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
                rows = []
                for at in np.split(order, edge[1:]):
                    s, t, e = start[at], end[at], entry[at]
                    rows.append((int(bucket[at[0]]), e.astype(np.int32).tobytes(), (s - c.start[c.lead[e]]).astype(np.int32).tobytes(),
                                 planes(c.first[e], 8), planes(core[at], 7), (t - s).astype(U8 if 2 * least < 256 else np.int32).tobytes(),
                                 pack.compress(b"".join(c.data[x:y].tobytes() for x, y in zip(s, t)))))
                yield arrow(kinds, chunk=[r["chunk"]] * len(rows), **dict(zip(list(kinds)[1:], zip(*rows))))
    return run


def enhanced_suffixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, least: int):
    """Suffix array of all suffixes of at least ``least`` bytes of the strings data[start:end], and common prefixes.

    Returns, in order: place of each suffix, its string, and the length of the prefix it shares with the one before.
    """
    count = end - start - least + 1
    string = np.repeat(np.arange(len(start)), count)
    place = np.repeat(start, count) + np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    left = end[string] - place
    width = int((end - start).max())
    padded = np.append(data, np.zeros(width, U8))
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[place]
    rows[np.arange(width)[None, :] >= left[:, None]] = 0
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, place, string, left = rows[order], place[order], string[order], left[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    return place, string, np.append(0, common)


def maximal_repeats(common: np.ndarray, before: np.ndarray, doc: np.ndarray, least: int):
    """Stack scan of the interval tree: (first, last, length, smallest document) of every maximal repeat.

    ``before`` is the byte left of a suffix, or -1 where its string starts: then nothing is known to extend it.
    """
    out: list[tuple[int, int, int, int]] = []
    deep = np.flatnonzero(common >= least)
    if not len(deep):
        return out
    edge = np.flatnonzero(np.append(True, np.diff(deep) != 1))
    for s, e in zip(deep[edge], np.append(deep[edge[1:] - 1], deep[-1])):
        # Suffixes s - 1 .. e share at least ``least`` bytes each with the next; intervals: [length, first, document, left byte]
        stack: list[list[int]] = []
        lcp, left, docs = common[s:e + 1].tolist(), before[s - 1:e + 1].tolist(), doc[s - 1:e + 1].tolist()
        for i in range(len(lcp) + 1):
            length = lcp[i] if i < len(lcp) else 0
            node = [0, s - 1 + i, docs[i], left[i]]
            while stack and stack[-1][0] > length:
                top = stack.pop()
                top[2] = min(top[2], node[2])
                top[3] = top[3] if top[3] == node[3] else -1
                if top[3] == -1:
                    out.append((top[1], s - 1 + i, top[0], top[2]))
                node = top
            if length < least:
                continue
            if stack and stack[-1][0] == length:
                stack[-1][2] = min(stack[-1][2], node[2])
                stack[-1][3] = stack[-1][3] if stack[-1][3] == node[3] else -1
            else:
                stack.append([length, node[1], node[2], node[3]])
    return out


def compare(least: int):
    """Covered spans of the stretches with parts in a bucket: per chunk, entry, start and length in the stretch."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"".join(unpack.decompress(x) for x in part["data"]), U8)
        length = np.frombuffer(b"".join(part["lengths"]), U8 if 2 * least < 256 else np.int32).astype(np.int64)
        entry, shift = (np.frombuffer(b"".join(part[c]), np.int32).astype(np.int64) for c in ("entries", "shifts"))
        doc = np.concatenate([unplanes(x, 8) for x in part["docs"]]).view(np.int64)
        core = np.concatenate([unplanes(x, 7) for x in part["cores"]])
        chunk = np.repeat(part["chunk"].to_numpy(), [len(x) // 4 for x in part["entries"]])
        end = np.cumsum(length)
        start = end - length
        text = mix(Prefixes(BYTE_CODE[data]).hash(start, end) ^ length.astype(U64))
        order = np.lexsort((doc, text, core))
        a, s, d = core[order], text[order], doc[order]
        new_core = np.append(True, a[1:] != a[:-1])
        new_text = new_core | np.append(True, s[1:] != s[:-1])
        of_core, of_text = np.cumsum(new_core) - 1, np.cumsum(new_text) - 1
        leads = np.flatnonzero(new_text)
        first = d[leads][of_text]
        # A part that an earlier document has as a whole is covered; of the others, the first of equal ones is compared.
        copy = order[d > first]
        spans = [np.stack([copy, np.zeros(len(copy), np.int64), length[copy]], axis=1)]
        lowest, highest = (f.reduceat(d, np.flatnonzero(new_core)) for f in (np.minimum, np.maximum))
        several = ((np.bincount(of_core[leads]) > 1) & (lowest < highest))[of_core]
        group = np.flatnonzero(several & (d == first))
        if len(group):
            # Rows of one document with equal parts share the answer of the first of them.
            member = np.flatnonzero(several[leads])
            head = order[leads[member]]
            place, string, common = enhanced_suffixes(data, start[head], end[head], least)
            before = np.where(place > start[head][string], data[np.maximum(place - 1, 0)].astype(np.int64), -1)
            groups = np.array(maximal_repeats(common, before, doc[head][string], least), np.int64).reshape(-1, 4)
            size = groups[:, 1] - groups[:, 0] + 1
            of = np.repeat(np.arange(len(groups)), size)
            leaf = np.repeat(groups[:, 0], size) + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            later = doc[head][string[leaf]] > groups[of, 3]
            of, leaf = of[later], leaf[later]
            found = np.unique(np.stack([string[leaf], place[leaf] - start[head][string[leaf]], groups[of, 2]], axis=1), axis=0)
            owner = np.full(len(leads), -1)
            owner[member] = np.arange(len(member))
            owner = owner[of_text[group]]
            low, high = (np.searchsorted(found[:, 0], owner, side) for side in ("left", "right"))
            many = high - low
            row = np.repeat(group, many)
            at = np.repeat(low, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            spans.append(np.stack([order[row], found[at, 1], found[at, 2]], axis=1))
        span = np.concatenate(spans)
        frame = pd.DataFrame({"chunk": chunk[span[:, 0]], "entry": entry[span[:, 0]], "at": shift[span[:, 0]] + span[:, 1], "n": span[:, 2]})
        rows = [(int(c), *(x[f].to_numpy(np.int32).tobytes() for f in ("entry", "at", "n")))
                for c, x in frame.groupby("chunk", sort=False)]
        return pd.DataFrame(rows, columns=["chunk", "entry", "at", "n"])
    return run


def finish(least: int, k: int, crowd: int, buckets: int):
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r["ids"], r["ends"], r["data"], least, k, crowd)
                code = codes_of(c, r["answers"], buckets)
                doc = c.ids[c.run_doc]
                lead = doc == c.first[c.entry] if c.entries else np.empty(0, bool)
                whole = ~lead | (code[c.entry] == 1) if c.entries else np.empty(0, bool)
                starts, stops = [c.start[whole]], [c.end[whole]]
                if r["spans"]:
                    entry, at, n = (np.frombuffer(b"".join(x[f] for x in r["spans"]), np.int32).astype(np.int64)
                                    for f in ("entry", "at", "n"))
                    order = np.argsort(entry, kind="stable")
                    entry, at, n = entry[order], at[order], n[order]
                    runs = np.flatnonzero(lead)
                    low, high = (np.searchsorted(entry, c.entry[runs], side) for side in ("left", "right"))
                    many = high - low
                    row = np.repeat(runs, many)
                    span = np.repeat(low, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    starts.append(c.start[row] + at[span])
                    stops.append(starts[-1] + n[span])
                change = np.zeros(len(c.data) + 1, np.int32)
                np.add.at(change, np.concatenate(starts), 1)
                np.add.at(change, np.concatenate(stops), -1)
                gone = np.cumsum(change[:-1]) > 0
                out = []
                for i, (s, e) in enumerate(zip(np.append(0, c.ends[:-1]), c.ends)):
                    part = gone[s:e]
                    rises = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum())
                    out.append((None if r["nulls"][i] else int(c.ids[i]), int(e - s), int(part.sum()), rises,
                                c.data[s:e][~part].tobytes()))
                yield arrow(kinds, **dict(zip(kinds, zip(*out))))
    return run


def remove_repeats(docs: DataFrame, least: int = 50, k: int = 20, crowd: int = 16, bucket_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): documents without the strings that an earlier document holds.

    A chunk decides alone for anchors with at least ``crowd`` different stretches in it.
    """
    with Steps(docs.sparkSession) as steps:
        whole = steps.store(chunks(docs), "repeat-chunks")
        buckets = pieces_of(whole.agg(F.sum("bytes")).first()[0] or 0, bucket_bytes)
        texts = whole.select("chunk", "ids", "ends", "data")
        signed = texts.mapInArrow(sign(least, k, crowd, buckets), "chunk long, bucket int, anchors binary, stretches binary, docs binary")
        codes = steps.store(signed.groupBy("bucket").applyInPandas(decide, "chunk long, bucket int, codes binary"), "repeat-codes")
        answers = codes.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers"))
        told = whole.join(answers, "chunk", "left")
        sent = told.select("chunk", "ids", "ends", "data", "answers").mapInArrow(
            send(least, k, crowd, buckets),
            "chunk long, bucket int, entries binary, shifts binary, docs binary, cores binary, lengths binary, data binary")
        spans = steps.store(sent.groupBy("bucket").applyInPandas(compare(least), "chunk long, entry binary, at binary, n binary"),
                            "repeat-spans")
    spans = spans.groupBy("chunk").agg(F.collect_list(F.struct("entry", "at", "n")).alias("spans"))
    return told.join(spans, "chunk", "left").select("nulls", "ids", "ends", "data", "answers", "spans").mapInArrow(
        finish(least, k, crowd, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
