"""Language identification: kernel values against plain sets, ridge against its closed form, held-out accuracy, odd input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import catalog, language

SF = "/root/testdata/sf0.001"
TEXTS = ["The cat sat, on THE mat", "el gato está ÁRBOL árbol", "", "a", "ab", "\u4f60\u597d 123", "xyz" * 3000]


def grams(text):
    out = bytearray()
    raw = text.encode()
    for i, b in enumerate(raw):
        if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b += 0x20
        elif 65 <= b <= 90:
            b += 32
        elif b < 128 and not 97 <= b <= 122:
            b = 32
        out.append(b)
    found = {bytes(out[i:i + k]) for k in range(1, 5) for i in range(len(out) - k + 1)}
    places = set()
    for g in found:
        k = len(g)
        x = int.from_bytes(g, "little") ^ (0x9E3779B9 * k & 0xFFFFFFFF)
        places.add((x * 2654435761 & 0xFFFFFFFF) >> 14)
    return found, places


def test_presence_and_kernel_against_plain_sets():
    data = [t.encode() for t in TEXTS]
    rows = list(language.presence(data))
    assert [set(r.tolist()) for r in rows] == [grams(t)[1] for t in TEXTS]
    for text in TEXTS:
        found, places = grams(text)
        assert len(found) - len(places) <= 1  # places hardly ever collide in one text
    full = [i for i, r in enumerate(rows) if len(r)]
    kernel = language.Landmarks([rows[i] for i in full]).kernel([rows[i] for i in full], batch=2)
    for i, x in enumerate(full):
        for j, y in enumerate(full):
            a, b = grams(TEXTS[x])[1], grams(TEXTS[y])[1]
            assert abs(kernel[i, j] - len(a & b) / np.sqrt(len(a) * len(b))) < 1e-6


def test_all_rows_as_landmarks_give_plain_kernel_ridge():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 400, 60)) for _ in range(40)]
    label = np.arange(40) % 2
    weight = np.where(label == 1, 2.0, 0.5)
    target = np.stack([1.0 - 2 * label, 2.0 * label - 1], axis=1)
    held = language.Landmarks(rows)
    kernel = held.kernel(rows)
    root = language.inverse_root(kernel)
    got = kernel @ root @ language.ridge(kernel @ root, target, weight, 0.1)
    want = kernel @ np.linalg.solve(kernel + 0.1 * np.diag(1 / weight), target)
    assert np.abs(got - want).max() < 1e-3


def test_scores_are_products_with_landmarks_and_weights():
    texts = [f"{w} {w[::-1]} {i}" for i, w in enumerate(["alpha", "omega", "straße", "niño"] * 10)]
    rows = list(language.presence([t.encode() for t in texts]))
    model = language.train(rows, [("x", "y", "z")[i % 3] for i in range(40)], landmarks=12)
    batch = language.values_of([t.encode() for t in texts] + [b""], model["product"])
    for i, row in enumerate(rows):
        assert np.allclose(batch[i], model["product"][row].sum(axis=0, dtype=np.float64) / np.sqrt(len(row)))
    assert not batch[-1].any() and np.allclose(language.shares(batch, 2.0).sum(axis=1), 1)


def test_registered_query_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in catalog.table(spark, SF, "documents").collect()}
    got = catalog.op11_string_kernel_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97


def test_only_rows_at_hand_are_learned_from(spark):
    docs = catalog.table(spark, SF, "documents")
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "no such language").otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(wrong)
    assert a["names"] == b["names"] and np.array_equal(a["product"], b["product"])


@pytest.fixture(scope="module")
def odd(spark):
    english, german = "the mouth of the river and the hills", "der Mund und die Berge sowie ein Flu\u00df"
    rows = [(i, (english if i % 2 else german) + f" {i}", "en" if i % 2 else "de") for i in range(1, 60)]
    rows += [(70, None, "en"), (71, "", "en"), (72, "123 \n ?", "en"), (73, "the river " * 60_000, None), (None, english, "xx"), (74, german, None)]
    rows += [(1, rows[0][1], "en")] * 50
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {c: F.lit(c) for c in ("n", "h", "rank", "places", "model", "score", "lang_pred")})


def test_odd_rows(spark, odd):
    def run(learned, asked):
        found = language.predictor(spark, language.fit(learned))
        rows = asked.select("doc_id", found(F.col("text")).alias("p")).collect()
        return {r.doc_id: (r.p.lang_pred, r.p.score) for r in rows}, len(rows)

    got, n = run(odd, odd)
    assert n == odd.count()
    assert got[70] == got[71] == got[72] == ("und", 0.0)
    assert got[73][0] == "en" and got[74][0] == "de" and got[None][0] == "en"
    assert run(odd, odd.where("false")) == ({}, 0)
    nothing, _ = run(odd.where("false"), odd)
    assert set(nothing.values()) == {("und", 0.0)}
    one, _ = run(odd.where("lang = 'en'"), odd)
    assert one[74] == ("en", 1.0) and one[71] == ("und", 0.0)
    two, _ = run(odd.where("doc_id IN (1, 2, 3)"), odd)
    assert all(0 <= s <= 1 for _, s in two.values())


def test_the_sample_is_bounded_and_fair(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"),
                                    F.when(F.col("id") < 20, "rare").when(F.col("id") < 1500, "some").otherwise("much").alias("lang"))
    got = {r.lang: r["count"] for r in language.sampled(docs, 250, 150).groupBy("lang").count().collect()}
    rare = docs.where(~language.held_out(F.col("doc_id")) & (F.col("lang") == "rare")).count()
    assert got["rare"] == rare and sum(got.values()) == 250 and abs(got["some"] - got["much"]) <= 1
