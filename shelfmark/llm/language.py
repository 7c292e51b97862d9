"""Language identification: a string kernel over n-grams, Nyström landmarks, and one-versus-rest kernel ridge regression.

The kernel is the blended spectrum of presence: two texts share as many n-grams, of 1 to 4 bytes, as both hold at all, divided by the
root of the product of how many each holds. Letters A-Z and Latin-1 capitals are folded, and all ASCII but letters
is one sign. N-grams are hashed to 2 ** 18 places.

1. At most ``per_language`` rows of each language, and ``sample`` in all, are taken by a hash of their id; that is the only bound.
2. One task fits them. Some of them, as many of each language as can be, are the landmarks. Kernel values of batches of rows with the
   landmarks are products of matrices; the inverse root of the landmarks' own kernel turns them into features. For each
   language, ridge regression against all others, languages weighing the same, gives one weight per landmark. The penalty, and the
   slope that turns values into scores, are chosen on a fifth of the rows.
3. The kernel is an inner product of presence vectors, so landmarks and weights multiply to one matrix of n-grams by languages, of
   fixed size. Batches of whole texts are scored by the product of their presence with it; nothing is shuffled.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0, and so is every text if nothing could be
learned; with one language only, it is the answer, with score 1. Rows without a language, text or id, or held out, are not learned
from; rows that share id and language are one. Other columns are ignored, or passed through by the caller.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import text_runs

BITS = 18
SIZE = 1 << BITS
LONGEST = 4
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[65:91] = FOLD[97:123] = np.arange(97, 123)
UNKNOWN = "und"
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)
SLOPES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)


def folded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = FOLD[raw]
    capital = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97) & (raw[:-1] == 0xC3)) + 1
    out[capital] += 0x20
    return out


def presence(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Places of the distinct n-grams of each text, rising."""
    data = folded(b"\n".join(texts) + b"\n" + b"\0" * LONGEST).astype(np.uint32)
    n = len(data) - LONGEST
    code, places = np.zeros(n, np.uint32), []
    for k in range(LONGEST):
        code = code | data[k:n + k] << np.uint32(8 * k)
        places.append(((code ^ np.uint32(0x9E3779B9 * (k + 1) & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    flag = np.zeros(SIZE, bool)
    at = 0
    for text in texts:
        end = at + len(text)
        for k, place in enumerate(places):
            flag[place[at:max(end - k, at)]] = True
        found = np.flatnonzero(flag)
        flag[found] = False
        yield found
        at = end + 1


class Landmarks:
    """Presence vectors of the landmarks, of unit length, and kernel values with batches of others."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.places = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.int64)
        self.matrix = np.zeros((len(self.places), len(rows)), np.float32)
        for i, row in enumerate(rows):
            self.matrix[np.searchsorted(self.places, row), i] = 1 / np.sqrt(len(row))

    def kernel(self, rows: list[np.ndarray], batch: int = 256) -> np.ndarray:
        column = np.full(SIZE, -1, np.int64)
        column[self.places] = np.arange(len(self.places))
        out = np.zeros((len(rows), self.matrix.shape[1]))
        for start in range(0, len(rows), batch):
            held = rows[start:start + batch]
            dense = np.zeros((len(held), len(self.places)), np.float32)
            for i, row in enumerate(held):
                at = column[row]
                dense[i, at[at >= 0]] = 1 / np.sqrt(len(row))
            out[start:start + len(held)] = dense @ self.matrix
        return out


def inverse_root(kernel: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of the square root: the map from kernel values with the landmarks to features."""
    values, axes = np.linalg.eigh((kernel + kernel.T) / 2)
    real = values > 1e-6 * values.max()
    return (axes[:, real] / np.sqrt(values[real])) @ axes[:, real].T


def ridge(features: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """One column of weights for each column of ``target``."""
    gram = features.T @ (features * weight[:, None])
    return np.linalg.solve(gram + penalty * np.eye(len(gram)), features.T @ (target * weight[:, None]))


def shares(values: np.ndarray, slope: float) -> np.ndarray:
    """Per row, shares of 1 for the languages; the same for values that differ by a positive factor."""
    scale = np.abs(values).max(axis=1, keepdims=True)
    e = np.exp(slope * (values / np.where(scale, scale, 1)))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[np.ndarray], langs: list[str], landmarks: int = 256) -> dict:
    names = sorted(set(langs))
    if len(names) < 2:
        return {"names": names}
    label = np.searchsorted(names, langs)
    turn = np.empty(len(rows), np.int64)  # place of a row among those of its language
    for y in range(len(names)):
        at = np.flatnonzero(label == y)
        turn[at] = np.arange(len(at))
    held = Landmarks([rows[i] for i in np.lexsort((label, turn))[:landmarks]])
    root = inverse_root(held.kernel([rows[i] for i in np.lexsort((label, turn))[:landmarks]]))
    features = held.kernel(rows) @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = len(rows) / len(names) / np.bincount(label)[label]
    tune = turn % 5 == 4
    if not tune.any():
        tune[:] = True
    fit = ~tune if (~tune).any() else tune
    best = None
    for penalty in PENALTIES:
        values = features[tune] @ ridge(features[fit], target[fit], weight[fit], penalty)
        for slope in SLOPES:
            fitness = float((weight[tune] * np.log(shares(values, slope)[np.arange(tune.sum()), label[tune]] + 1e-9)).mean())
            if best is None or fitness > best[0]:
                best = fitness, penalty, slope
    weights = root @ ridge(features, target, weight, best[1])
    product = np.zeros((SIZE, len(names)), np.float32)
    product[held.places] = held.matrix @ weights
    return {"names": names, "product": product, "slope": best[2]}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(docs: DataFrame, sample: int, per_language: int) -> DataFrame:
    """(doc_id, lang) of the rows to learn from: no language has more than ``per_language``, all have ``sample`` at most."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # Rows are thinned by their hash to some multiple of what is wanted before they meet by language.
    # No more languages than rows can be learned from, so at most ``sample`` counts are sent to every task.
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    near = known.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 20)) * F.col("n") < F.lit((1 << 20) * 4 * per_language))
    ranked = near.select("doc_id", "lang", "h").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    return ranked.where(F.col("rank") <= per_language).orderBy("rank", "h", "lang").limit(sample).select("doc_id", "lang").distinct()


def fit(docs: DataFrame, sample: int = 6_000, per_language: int = 1_500, landmarks: int = 256) -> dict:
    """A model from ``docs(doc_id, text, lang)``."""
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # At most ``sample`` pairs of an id and a language are sent to every task.
    chosen = sampled(docs, sample, per_language)
    rows = docs.where("text IS NOT NULL").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, texts in text_runs(frame["text"]):
                places = [p.astype(np.int32).tobytes() for p in presence(texts)]
                yield pd.DataFrame({"lang": frame["lang"].iloc[start:start + len(texts)].to_numpy(), "places": places})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["places"].map(len) > 0].sort_values(["lang", "places"])
        # Neighbours in this order are alike; a fixed shuffle makes landmarks and tuning rows a fair choice.
        part = part.sample(frac=1.0, random_state=11)
        model = train([np.frombuffer(p, np.int32) for p in part["places"]], part["lang"].tolist(), landmarks)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    found = rows.mapInPandas(describe, "lang string, places binary").groupBy(F.lit("all").alias("all")).applyInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else {"names": []}


def values_of(texts: list[bytes], product: np.ndarray) -> np.ndarray:
    """The presence of a batch of texts times the matrix of n-grams by languages."""
    places = list(presence(texts))
    size = np.array([len(p) for p in places])
    rows = product[np.concatenate(places)]
    out = np.zeros((len(texts), product.shape[1]))
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(rows, (np.cumsum(size) - size)[some], axis=0, dtype=np.float64) / np.sqrt(size[some])[:, None]
    return out


def predictor(spark, model: dict):
    """A column function: struct of the language (``lang_pred``) and its score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array(m["names"], object)
        for part in parts:
            if "product" not in m:
                yield pd.DataFrame({"lang_pred": [names[0] if len(names) else UNKNOWN] * len(part), "score": np.full(len(part), float(len(names)))})
                continue
            found = [shares(values_of(texts, m["product"]), m["slope"]) for _, texts in text_runs(part)]
            found = np.concatenate(found) if found else np.zeros((0, len(names)))
            best = found.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": names[best], "score": found[np.arange(len(part)), best]})

    def of(text: Column) -> Column:
        text = text.cast("string")
        unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
        return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), predict(F.coalesce(text, F.lit("")))).otherwise(unknown)

    return of
