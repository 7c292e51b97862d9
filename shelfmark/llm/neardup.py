"""Near-duplicate documents: fast similarity sketches, banding, and confirmation on full shingle sets.

1. Words are cut and hashed with numpy; a document's set is its distinct shingles (with fewer words, the whole sequence). Documents
   with equal sets are one class, so copies cost one row each and no pairs.
2. A sketch has t bins. In round i < t every shingle throws its i-th hash value into the bin that it names; in round
   t + i all shingles throw into bin i. A bin keeps the smallest value of the first round that reaches it, so after 2t
   rounds every bin of a set that isn't empty is filled (Dahlgaard, Knudsen and Thorup, 2017).
3. Classes that agree in a band of bins are candidates. Bands name their smallest member, the components of these stars are the
   candidate groups, and each group is confirmed once, however many bands it shares.
4. A group is compared in blocks: pairs of blocks are dealt to tasks, sizes of intersections come from a product of
   incidence matrices over full sets, and a task returns a spanning forest of the links it confirmed, never all pairs.
   The components of these links are the result.

Texts are only read by scans; a fixed-size bitmap of candidate ids keeps all other sets from being shuffled.

Defined results: null or empty text and text without words has an empty set and links with nothing. Rows that share a
document id are one node. A null id is left out of linking and gets a null component, and is kept. Repeated rows give
a row each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import BYTE_CODE, Bitmap, Prefixes, arrow, components, mix, pieces_of, store, text_runs

BANDS, ROWS = 20, 6
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SALTS = np.random.default_rng(10).integers(1, 2**63, 2 * BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, lower-cased in A-Z."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.append(0, edge)
    start, end = edge[0::2], edge[1::2]
    hashes = Prefixes(BYTE_CODE[LOWER[data]])
    word = mix(hashes.hash(start, end) ^ (end - start).astype(np.uint64))
    rows = Prefixes(word)
    upto = np.searchsorted(start, ends_at)
    since = np.append(0, upto[:-1])
    first = np.arange(max(len(word) - words + 1, 0))
    shingle = mix(rows.hash(first, first + words))
    out = []
    for a, b in zip(since, upto):
        if b - a >= words:
            out.append(np.unique(shingle[a:b - words + 1]))
        elif b > a:
            whole = rows.hash(np.array([a]), np.array([b])) + np.uint64(b - a)
            out.append(mix(mix(whole)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketch(values: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes: one value per bin."""
    size = np.uint64(bins)
    out = np.full(bins, 2**64 - 1, np.uint64)
    missing = np.ones(bins, bool)
    for i in range(bins):
        thrown = mix(values + SALTS[i])
        bin_ = ((thrown >> np.uint64(32)) % size).astype(np.int64)
        open_ = missing[bin_]
        np.minimum.at(out, bin_[open_], thrown[open_])
        missing[bin_] = False
        if not missing.any():
            return out
    for b in np.flatnonzero(missing):
        out[b] = mix(values + SALTS[bins + b]).min()
    return out


def describe(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, low, high, bands): size and 128-bit signature of the set, and a hash of each band."""
    kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "low": pa.int64(), "high": pa.int64(),
             "bands": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            for start, texts in text_runs(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, words)
                low = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                high = [int(mix(s ^ SALTS[0]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                named = []
                for s in sets:
                    if not len(s):
                        named.append([])
                        continue
                    bins = sketch(s, bands * rows).reshape(bands, rows)
                    value = np.full(bands, 17, np.uint64) + np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        value = mix(value ^ bins[:, r])
                    named.append(value.view(np.int64).tolist())
                yield arrow(kinds, doc_id=keys.slice(start, len(texts)), n_shingles=[len(s) for s in sets], low=low, high=high,
                            bands=named)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, low long, high long, bands array<long>")


def sets_of(docs: DataFrame, wanted: Bitmap, words: int) -> DataFrame:
    """(doc_id, hashes) of the documents whose id may be in the bitmap."""
    kinds = {"doc_id": pa.int64(), "hashes": pa.binary()}
    shared = wanted.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(Bitmap.has(shared.value, batch.column("slot").to_numpy())))
            keys = batch.column("doc_id")
            for start, texts in text_runs(batch.column("text").to_pylist()):
                sets = shingle_sets(texts, words)
                yield arrow(kinds, doc_id=keys.slice(start, len(sets)), hashes=[s.tobytes() for s in sets])

    return docs.where("doc_id IS NOT NULL").withColumn("slot", Bitmap.slot(F.col("doc_id"))).mapInArrow(
        run, "doc_id long, hashes binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of incidence matrices a few thousand shared shingles at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a = np.repeat(np.arange(len(left)), [len(s) for s in left])
    row_b = np.repeat(np.arange(len(right)), [len(s) for s in right])
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)

    def placed(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = np.flatnonzero(shared[at] == values) if len(shared) else np.empty(0, np.int64)
        hit = hit[np.argsort(at[hit], kind="stable")]
        return at[hit], row[hit]

    (col_a, row_a), (col_b, row_b) = placed(a, row_a), placed(b, row_b)
    step = 4096
    for start in range(0, len(shared), step):
        x, y = (np.zeros((n, step), np.float32) for n in (len(left), len(right)))
        for m, col, row in ((x, col_a, row_a), (y, col_b, row_b)):
            s, e = np.searchsorted(col, (start, start + step))
            m[row[s:e], col[s:e] - start] = 1
        out += x @ y.T
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node reached) of the components of a symmetric matrix of links."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return [(i, int(c)) for i, c in enumerate(label) if c != i]
        label = new


def confirm(percent: int):
    """Spanning edges of the confirmed links of each cell in a group of cells."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        for _, cell in part.groupby(["c", "i", "j"], sort=False):
            i, j = int(cell["i"].iloc[0]), int(cell["j"].iloc[0])
            ids, sets = cell["doc_id"].to_numpy(), [np.frombuffer(h, np.uint64) for h in cell["hashes"]]
            size = np.array([len(s) for s in sets], np.int64)
            block = cell["block"].to_numpy()
            a, b = (np.flatnonzero(block == x) for x in (i, j))
            if not len(a) or not len(b):
                continue
            shared = intersections([sets[x] for x in a], [sets[x] for x in b]).astype(np.int64)
            union = size[a][:, None] + size[b][None, :] - shared
            links = np.zeros((len(ids), len(ids)), bool)
            links[np.ix_(a, b)] = 100 * shared >= percent * union
            edges += [(int(ids[x]), int(ids[y])) for x, y in forest(links | links.T)]
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)
    return run


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(id, component) of classes that share a band with another, by components of stars."""
    bands = classes.select("rep", F.posexplode("bands").alias("k", "band"))
    stars = bands.groupBy("k", "band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    return components(bands.join(stars.drop("high"), ["k", "band"]).where("rep <> low").select(
        F.col("rep").alias("a"), F.col("low").alias("b")))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, bands: int = BANDS, rows: int = ROWS,
                    block: int = 256, cell_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): links are pairs with 100 * intersection >= percent * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = store(describe(docs, words, bands, rows), "near-facts")
    key = ["low", "high", "n_shingles"]
    usable = facts.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = usable.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    classes = facts.join(reps, (facts["doc_id"] == reps["rep"]) & (facts["low"] == reps["low"])
                         & (facts["high"] == reps["high"]) & (facts["n_shingles"] == reps["n_shingles"])).select("rep", "bands")
    groups = store(candidate_groups(classes), "near-groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    dealt = groups.join(sizes, "component").select(
        F.col("id").alias("doc_id"), F.col("component").alias("c"),
        F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int").alias("blocks"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    sets = sets_of(docs, Bitmap(groups, "id"), words).join(dealt, "doc_id")
    cells = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "doc_id", "hashes", "c", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    many = facts.join(groups, facts["doc_id"] == groups["id"]).agg(F.sum("n_shingles")).first()[0] or 0
    cells = cells.withColumn("g", F.pmod(F.xxhash64("c", "i", "j"), F.lit(pieces_of(8 * many, cell_bytes))))
    links = store(cells.groupBy("g").applyInPandas(confirm(percent), "a long, b long"), "near-links")
    linked = components(links)
    member = reps.join(linked, reps["rep"] == linked["id"], "left").select(
        *key, F.coalesce("component", "rep").alias("component_id"))
    out = facts.drop("bands").join(member, key, "left")
    alone = (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
