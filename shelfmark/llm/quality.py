"""Quality classifier: naive Bayes support vectors, fitted by dual coordinate descent.

Features are indicators of hashed n-grams: bytes of the text (3 and 4), and shapes of its words (1 to 4 in a row; a shape tells
case, digits, signs and whether the word repeats the one before). Each is scaled by its class log-count ratio; a linear hinge-loss
model over the scaled, length-normalised indicators is fitted by dual coordinate descent, and margins are turned into scores from 0
to 1 by a sigmoid fitted on rows that the descent did not see.

The model is fitted in one task on at most ``sample`` labelled rows, taken by a hash of their id; that is the only bound.
It has a fixed size (2 ** 18 weights), which is what goes to the tasks. Scoring reads whole texts and shuffles nothing.

Defined results: null text is empty; a text without n-grams gets the score of the bias; rows without a label, or with null ids,
are not learned from; ids labelled more than once count with their highest label; with no labels or one class only, every score is
the smoothed share of label 1. Other columns are passed through untouched.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import BYTE_CODE, Prefixes, text_runs

BITS = 18
SIZE = 1 << BITS
KINDS = np.zeros((256, 4), np.uint8)  # upper case, lower case, digit, sign
KINDS[65:91, 0] = KINDS[97:123, 1] = KINDS[128:, 1] = KINDS[48:58, 2] = 1
KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?"], 3] = 1
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _slot(x: np.ndarray, salt: int) -> np.ndarray:
    return ((x + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def word_shapes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and shape (0..63) of every word."""
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, np.empty(0, np.uint32)
    sums = np.zeros((len(data) + 1, 4), np.int32)
    np.cumsum(KINDS[data], axis=0, out=sums[1:], dtype=np.int32)
    upper, lower, digit, sign = (sums[end] - sums[start]).T
    name = Prefixes(BYTE_CODE[data]).hash(start, end)
    again = np.append(False, name[1:] == name[:-1])
    shape = (again * 1 + (upper > 0) * 2 + (lower > 0) * 4 + (digit > 0) * 8 + (sign > 0) * 16 + (sign > 1) * 32)
    return start, shape.astype(np.uint32)


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Slots of the distinct n-grams of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n\0\0\0", np.uint8)
    n = len(data) - 3
    wide = data.astype(np.uint32)
    three = wide[:n] | wide[1:n + 1] << np.uint32(8) | wide[2:n + 2] << np.uint32(16)
    four = _slot(three | wide[3:n + 3] << np.uint32(24), 1)
    three = _slot(three, 2)
    start, shape = word_shapes(data[:n])
    grams, value = [], np.zeros(len(shape), np.uint32)
    for k in range(1, 5):  # shapes of the k words from each word on
        value = value[:len(shape) - k + 1] * np.uint32(64) + shape[k - 1:]
        grams.append(_slot(value, 1000 + k))
    flag = np.zeros(SIZE, bool)
    at = 0
    for text in texts:
        end = at + len(text)
        flag[three[at:max(end - 2, at)]] = True
        flag[four[at:max(end - 3, at)]] = True
        a, b = np.searchsorted(start, (at, end))
        for k, g in enumerate(grams):
            flag[g[a:max(b - k, a)]] = True
        found = np.flatnonzero(flag)
        flag[found] = False
        yield found
        at = end + 1


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of how much likelier each n-gram is under label 1."""
    counts = [np.full(SIZE, smooth) for _ in range(2)]
    for slots, y in zip(rows, label):
        counts[int(y)][slots] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: float, epochs: int,
                       tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model: one dual variable at a time, each within [0, cost]."""
    weight, bias, dual = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v for v in values]) + 1.0
    order = np.random.default_rng(3)
    for _ in range(epochs):
        widest = 0.0
        for i in order.permutation(len(rows)):
            slots, v, y = rows[i], values[i], sign[i]
            slope = y * (weight[slots] @ v + bias) - 1
            new = min(max(dual[i] - slope / norm[i], 0.0), cost)
            step = new - dual[i]
            if step:
                weight[slots] += step * y * v
                bias += step * y
                dual[i] = new
                widest = max(widest, abs(step))
        if widest < tolerance * cost:
            break
    return weight, bias


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score as a function of the margin, with smoothed targets (Platt)."""
    ones, zeros = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - target) + 1e-6 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def scaled(slots: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[slots]
    length = np.sqrt(v @ v)
    return v / length if length else v


def train(rows: list[np.ndarray], label: np.ndarray, cost: float = 10.0, epochs: int = 20) -> dict:
    share = (label.sum() + 1) / (len(label) + 2)
    if len(label) < 10 or min(label.sum(), (1 - label).sum()) < 5:
        return {"share": float(share)}
    ratio = log_count_ratios(rows, label)
    values = [scaled(s, ratio) for s in rows]
    sign = np.where(label == 1, 1.0, -1.0)
    tune = np.zeros(len(rows), bool)
    for y in (0, 1):
        tune[np.flatnonzero(label == y)[::5]] = True
    fit, held = np.flatnonzero(~tune), np.flatnonzero(tune)
    weight, bias = coordinate_descent([rows[i] for i in fit], [values[i] for i in fit], sign[fit], cost, epochs)
    margin = np.array([weight[rows[i]] @ values[i] + bias for i in held])
    slope, offset = sigmoid_fit(margin, label[held])
    return {"product": (weight * ratio).astype(np.float32), "square": np.square(ratio).astype(np.float32), "bias": bias,
            "slope": slope, "offset": offset}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> dict:
    """A model from at most ``sample`` rows of ``labels(doc_id, label)`` and their texts in ``docs(doc_id, text)``."""
    chosen = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(
        F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers are sent to every task.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, texts in text_runs(frame["text"]):
                yield pd.DataFrame({"label": frame["label"].iloc[start:start + len(texts)].to_numpy(),
                                    "slots": [s.astype(np.int32).tobytes() for s in features(texts)]})

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["label", "slots"])
        slots = [np.frombuffer(s, np.int32) for s in part["slots"]]
        return pd.DataFrame({"model": [pickle.dumps(train(slots, part["label"].to_numpy()))]})

    found = rows.mapInPandas(describe, "label int, slots binary").groupBy(F.lit("all").alias("all")).applyInPandas(run, "model binary").first()
    return pickle.loads(found["model"]) if found else {"share": 0.5}


def scorer(spark, model: dict):
    """A column function: score of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for part in parts:
            if "share" in m:
                yield pd.Series(np.full(len(part), m["share"]))
                continue
            margin = []
            for _, texts in text_runs(part):
                for slots in features(texts):
                    length = np.sqrt(m["square"][slots].sum(dtype=np.float64))
                    margin.append(m["product"][slots].sum(dtype=np.float64) / length + m["bias"] if length else m["bias"])
            yield pd.Series(1 / (1 + np.exp(-np.clip(m["slope"] * np.array(margin) + m["offset"], -35, 35))), dtype="float64")

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of ``labels.quality``, learned from the rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return fit(docs, known.where(~held_out(F.col("doc_id"))))
