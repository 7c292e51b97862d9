"""Spelling variants against all pairs of words, and on odd input."""

import random

from pyspark.sql import functions as F

from shelfmark.llm import catalog, spelling
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_registered_query_against_all_pairs(spark):
    docs = catalog.table(spark, SF, "documents")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = found(catalog.op12_spelling_variants(spark, SF))
    assert got == brute.spelling_variants(texts, 199) and any(v[0] for v in got.values())


def test_every_edit_of_words_with_runs_of_equal_letters(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab\u00e9") for _ in range(rng.randint(6, 9))) for _ in range(700)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaabaaaa", "aaabbaaaa"}
    rows = [(w, rng.choice([5, 6, 30, 200, 2000])) for w in sorted(words)]
    got = found(spelling.variants(spark.createDataFrame(rows, "word string, n int")))
    text = " ".join(f"{w} " * n for w, n in rows)
    assert got == brute.spelling_variants([(1, text)], 10**12)
    assert any(v[0] != v[1] for v in got.values() if v[0])


def test_odd_rows(spark):
    text = "Colour colour \u00c9toile1\u00c9toile \u00c9toile,\u00c9toile \u00c9toile short colour" + " colour_colour colours" * 40_000
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (None, None), (4, "1234 \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("word", "run", "n", "h", "doc", "form")})
    for one_in in (0, 3):
        got = found(spelling.variants(spelling.corpus_words(docs, one_in=one_in)))
        assert got == brute.spelling_variants(rows, one_in or 10**12) and got
    assert found(spelling.variants(spelling.corpus_words(docs.where("false")))) == {}


def test_ties_go_to_the_smallest_word_and_forms_chain(spark):
    rows = [("harbor", 5), ("harbour", 25), ("harbou", 25), ("harbours", 125), ("harboura", 125), ("harbourss", 700), ("lonely", 9)]
    got = found(spelling.variants(spark.createDataFrame(rows, "word string, n int")))
    assert got["harbor"] == ("harbou", "harbou", 5, 2, 25)
    assert got["harbour"] == ("harboura", "harboura", 25, 4, 125)
    assert got["harbours"] == ("harbourss", "harbourss", 125, 3, 700)
    assert got["lonely"] == (None, "lonely", 9, 0, None)


def test_a_failure_leaves_no_step_behind(spark, monkeypatch):
    import os

    from shelfmark.llm.common import Steps

    made = []
    store = Steps.store
    monkeypatch.setattr(Steps, "store", lambda self, df, name: made.append(store(self, df, name)) or made[-1])
    done = spelling.variants(spark.createDataFrame([("harbor", 5), ("harbour", 25)], "word string, n int"))
    left = [s._stored_at for s in made if os.path.exists(s._stored_at)]
    assert len(left) == 2 < len(made) and done.count() == 2  # the two that the result reads
    made.clear()
    monkeypatch.setattr(spelling, "ends", lambda *_: 1 / 0)
    try:
        spelling.variants(spark.createDataFrame([("harbor", 5), ("harbour", 25)], "word string, n int"))
    except ZeroDivisionError:
        pass
    assert len(made) == 3 and not any(os.path.exists(s._stored_at) for s in made)
