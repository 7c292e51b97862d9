"""Packing by lexical retrieval: windows filled with the neighbours that a BM25 index finds for the window's first document.

1. Token ids are made once and stored, as 16-bit numbers, in the shared folder.
2. Document frequencies and the mean length are counted over all documents. Terms are token ids, so the table of
   frequencies has at most one row per entry of the vocabulary; that bounds what goes to every task.
3. The stored documents are read in shards of ``shard_tokens`` tokens. A shard's inverted index holds the BM25 weights of all its
   terms. The document that opens a window asks it with all its terms; unused neighbours follow in order of
   score, the first that fits wholly before one that must be cut. What is cut off opens the next window. Stored order
   decides only where no unused document of the shard has a positive score.

So every window is full but the last of a task, which is taken apart into sequences whose lengths are powers of two.
Texts and tokens are never shuffled, and a shard bounds memory; only a single document is held whole.

Token ids equal those of the ``tokenizers`` file. They come from the same vocabulary as ranks, which encode several
times faster; the strings of special tokens are special in texts, as there.

Defined results: null text is empty and gives the end id alone; repeated rows are packed each; a null id stays null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow, store, text_runs

END_ID = 1
SPECIAL = {"<|endoftext|>": 50256}
VOCABULARY = 1 << 16


@lru_cache(maxsize=2)
def encoder(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def slow_encoder(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def token_ids(text: str, name: str) -> np.ndarray:
    """Ids of a text and the end id. Runs of about a million blanks are too much for the fast encoder's pattern."""
    try:
        ids = encoder(f"{name}.tiktoken").encode(text, allowed_special="all")
    except ValueError:
        ids = slow_encoder(f"{name}.json").encode(text, add_special_tokens=False).ids
    ids.append(END_ID)
    return np.array(ids, np.uint16)


def tokens(docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian 16-bit numbers."""
    kinds = {"doc_id": pa.int64(), "ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            for start, run_ in text_runs(texts.to_pylist()):
                out = [token_ids(data.decode("utf-8", "surrogatepass"), name).tobytes() for data in run_]
                yield arrow(kinds, doc_id=keys.slice(start, len(out)), ids=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids binary")


def statistics(stored: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents per term, documents, and mean length, over all documents."""
    kinds = {"term": pa.int32(), "docs": pa.int64(), "length": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, length = np.zeros(VOCABULARY, np.int64), 0, 0
        for batch in batches:
            for data in batch.column("ids").to_pylist():
                ids = np.frombuffer(data, np.uint16)
                seen[np.unique(ids)] += 1
                docs, length = docs + 1, length + len(ids)
        at = np.flatnonzero(seen)
        yield arrow(kinds, term=np.append(at, -1), docs=np.append(seen[at], docs),
                    length=np.append(np.zeros(len(at), np.int64), length))

    rows = stored.select("ids").mapInArrow(run, "term int, docs long, length long").groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("length").alias("length")).toPandas()
    frequency = np.zeros(VOCABULARY, np.int64)
    terms = rows[rows["term"] >= 0]
    frequency[terms["term"].to_numpy()] = terms["docs"].to_numpy()
    total = rows[rows["term"] < 0]
    docs, length = int(total["docs"].sum()), int(total["length"].sum())
    return frequency, docs, length / max(docs, 1)


class ShardIndex:
    """BM25 weights of a shard's documents, document after document; ``ask_terms``, if given, limits the terms of a query."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, ask_terms: int | None = None, k1: float = 1.2,
                 b: float = 0.75):
        found = [np.unique(ids[:-1], return_counts=True) for ids in docs]
        self.terms = [terms for terms, _ in found]
        self.idf, self.ask_terms, self.n = idf, ask_terms, len(docs)
        self.term = np.concatenate([*self.terms, np.empty(0, np.uint16)])
        count = np.concatenate([c for _, c in found]) if found else np.empty(0)
        sizes = np.array([len(t) for t in self.terms], np.int64)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        norm = k1 * (1 - b + b * np.array([len(ids) for ids in docs]) / mean)
        self.weight = (idf[self.term] * count * (k1 + 1) / (count + norm[doc])).astype(np.float32)
        self.filled = np.flatnonzero(sizes)  # documents with terms, and where their terms start
        self.start = (np.cumsum(sizes) - sizes)[self.filled]
        self.asked = np.zeros(VOCABULARY, np.float32)

    def neighbours(self, doc: int, unused: np.ndarray, most: int | None = None) -> np.ndarray:
        """Unused documents that share terms with ``doc``, best first: all of them, or the first ``most``."""
        terms = self.terms[doc]
        if self.ask_terms is not None and len(terms) > self.ask_terms:
            terms = terms[np.argsort(-self.idf[terms], kind="stable")[:self.ask_terms]]
        score = np.zeros(self.n, np.float32)
        if len(terms):
            self.asked[terms] = 1
            score[self.filled] = np.add.reduceat(self.weight * self.asked[self.term], self.start)
            self.asked[terms] = 0
        score *= unused
        top = np.flatnonzero(score > 0)
        return top[np.lexsort((top, -score[top]))][:most]


class Packer:
    """Fills windows shard by shard; the open window goes on from shard to shard."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.sequence = window, first_sequence
        self.open: list[tuple] = []  # (doc_id, start, ids of the piece, tokens of the document)
        self.fill = 0
        self.seed: int | None = None
        self.done: list[tuple] = []

    def close(self) -> None:
        offset = 0
        for doc_id, start, ids, total in self.open:
            self.done.append((doc_id, start, len(ids), total, self.sequence, offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.sequence += 1
        self.open, self.fill, self.seed = [], 0, None

    def place(self, key: int | None, doc: int, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, self.window - self.fill)
            self.open.append((key, start, ids[start:start + take], len(ids)))
            self.fill += take
            start += take
            if self.seed is None:
                self.seed = doc
            if self.fill == self.window:
                self.close()

    def shard(self, keys: list, docs: list[np.ndarray], index: ShardIndex) -> None:
        unused = np.ones(len(docs), bool)
        length = np.array([len(ids) for ids in docs])
        self.seed = None
        asked, near, following = None, np.empty(0, np.int64), 0
        for _ in range(len(docs)):
            pick = None
            if self.seed is not None:
                if asked != self.seed:
                    asked, near = self.seed, index.neighbours(self.seed, unused)
                near = near[unused[near]]
                if len(near):
                    fit = near[length[near] <= self.window - self.fill]
                    pick = int(fit[0] if len(fit) else near[0])
            if pick is None:
                while not unused[following]:
                    following += 1
                pick = following
            unused[pick] = False
            self.place(keys[pick], pick, docs[pick])
        self.seed = None

    def finish(self) -> None:
        """The last window, as sequences whose lengths are powers of two."""
        rest, self.open = self.open, []
        left = self.fill
        while rest:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc_id, start, ids, total = rest.pop(0)
                take = min(room, len(ids))
                self.open.append((doc_id, start, ids[:take], total))
                if take < len(ids):
                    rest.insert(0, (doc_id, start + take, ids[take:], total))
                room -= take
            self.close()


def pack(docs: DataFrame, window: int = 2048, vocabulary: str = "byte_bpe_50k", shard_tokens: int = 1 << 19,
         ask_terms: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, token_ids (little-endian 32 bits)."""
    stored = store(tokens(docs, vocabulary), "pack-tokens")
    frequency, total, mean = statistics(stored)
    idf = np.log1p((total - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf.tobytes())
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(),
             "sequence_id": pa.int64(), "offset": pa.int64(), "token_ids": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(shared.value, np.float32)
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def full() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(packer.done), 512):
                yield arrow(kinds, **dict(zip(kinds, zip(*packer.done[i:i + 512]))))
            packer.done = []

        for batch in batches:
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                keys.append(key)
                held.append(np.frombuffer(data, np.uint16))
                size += len(held[-1])
                if size >= shard_tokens:
                    packer.shard(keys, held, ShardIndex(held, weights, mean, ask_terms))
                    yield from full()
                    keys, held, size = [], [], 0
        packer.shard(keys, held, ShardIndex(held, weights, mean, ask_terms))
        packer.finish()
        yield from full()

    return stored.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
                                  "token_ids binary")
