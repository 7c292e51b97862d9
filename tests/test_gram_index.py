"""Searches over the index, and with a table of queries, against the scans they stand for."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import gram_index, many_queries, search
from shelfmark.operators.gram_index import GramIndex

WORDS = ["harbour", "plan", "notes", "Stra\u00dfe", "\u53f0\u8d26", "caf\u00e9", "a.b", "x_y", "100%", "plans"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Sixty files in four blocks of sixteen rows, each with words of its own."""
    from tests.conftest import AS_OF, DAY
    from shelfmark.operators.extract import extract_text
    from shelfmark.policy import Policy, Root
    from shelfmark.sources.corpus import describe

    pol = Policy(as_of_ms=AS_OF, roots=(Root("/w", "work"),), home="/home/me")
    rng = random.Random(3)
    rows = []
    for i in range(60):
        text = f"# {rng.choice(WORDS)} {i}\n" + " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))) + (" zebra" if i == 37 else "")
        rows.append(("/w", f"d{i % 3}/{rng.choice(WORDS)}-{i}.{'md' if i % 5 else 'secret.md'}", "" if i == 7 else text, len(text), AS_OF - i * DAY, i == 11, 1))
    raw = spark.createDataFrame(rows, "root string, rel string, text string, size long, mtime_ms long, gone boolean, scan_id long")
    files = extract_text(describe(raw.withColumn("path", F.concat_ws("/", "root", "rel")), pol), pol).drop("text").withColumn("is_binary", F.lit(False))
    path = str(tmp_path_factory.mktemp("gram"))
    files.coalesce(1).write.parquet(path + "/files")
    stored = spark.read.parquet(path + "/files")
    return stored, GramIndex.build(stored, path + "/index", rows_per_block=16), pol


def rows(df):
    return sorted(map(repr, df.collect()))


QUERIES = ["harbour", "plan notes", "zebra", "a", "\u8d26", "\u00e9 x", "stra\u00dfe 1", "HARBOUR Plan", "100%", "x_y a.b", "no such thing", "pla", "lan", "d1/", "",
           "harbour plan notes caf\u00e9", "\x00", "md", "-3", "zebra \x00"]


@pytest.mark.parametrize("query,scope", [(q, "all") for q in QUERIES] + [("plan notes", "name"), ("a", "content"), ("caf\u00e9", "content")])
def test_the_index_finds_what_a_scan_finds(corpus, query, scope):
    files, index, pol = corpus
    assert rows(index.search_files(query, pol, scope=scope, limit=200)) == rows(search.search_files(files, query, pol, scope=scope, limit=200))
    assert rows(index.search_total(query, pol, scope=scope)) == rows(search.search_total(files, query, pol, scope=scope))


def test_other_searches_and_the_way_for_common_terms(corpus):
    files, index, pol = corpus
    for word in ("plan notes", "caf\u00e9", "n", "zebra"):
        assert rows(index.search_keyword(word, pol)) == rows(search.search_keyword(files, word, pol))
        assert rows(index.search_simple(word)) == rows(search.search_simple(files, word))
    narrow = GramIndex(index.spark, index.path, broadcast_rows=3)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(narrow.rows(["harbour"])) and "BroadcastHashJoin" in plan(narrow.rows(["zebra"]))
    assert rows(narrow.search_files("harbour", pol)) == rows(search.search_files(files, "harbour", pol))


def test_only_blocks_with_candidates_are_read(spark, corpus, scratch):
    files, given, pol = corpus
    index = GramIndex.build(files, scratch + "/index", rows_per_block=16)
    df = index.search_files("zebra", pol)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text and "LeftSemi" in text
    postings = index.postings().where(index._within(gram_index.gram_codes("zebra")))
    assert "PartitionFilters: [lead" in postings._jdf.queryExecution().executedPlan().toString()
    want = rows(given.search_files("zebra", pol))
    (block,) = {r.block for r in index.candidates(index.choose(["zebra"])[0]).collect()}
    spoilt = 0
    for folder in glob.glob(scratch + "/index/docs/block=*"):
        if not folder.endswith(f"={block}"):
            for part in glob.glob(folder + "/*.parquet"):
                size = os.path.getsize(part)
                with open(part, "r+b") as out:  # of the same length, and not a table any more
                    out.write(b"x" * size)
                spoilt += 1
    assert spoilt == 3 and rows(df) == want and len(want) == 1


def test_candidates_are_few_and_complete(corpus):
    files, index, _ = corpus
    for term in ("harbour", "plans", "notes", "x_y"):
        ranges, most = index.choose([term])
        found = index.candidates(ranges).count()
        real = files.where(search.match_condition([term])).count()
        assert real <= found <= most and found - real <= 5
    assert index.choose(["qqq"])[1] == 0 and index.rows(["qqq"]).count() == 0


def test_an_empty_table_has_an_index(corpus, scratch):
    files, _, pol = corpus
    index = GramIndex.build(files.limit(0), scratch + "/none")
    assert index.search_files("harbour", pol).collect() == [] and index.search_total("a", pol).first().total == 0


def test_long_texts_and_equal_paths(spark, corpus, scratch):
    files, _, pol = corpus
    one = files.where("rel LIKE 'd1/%'").limit(1)
    long = one.withColumn("body", F.concat(F.repeat(F.lit("river bank "), 300_000), F.lit("zebra")))
    index = GramIndex.build(long.union(long), scratch + "/long", rows_per_block=4)
    assert index.search_total("zebra river", pol).first().total == 2


def test_a_table_of_queries_against_one_search_each(spark, corpus):
    files, _, pol = corpus
    asked = [(i, q) for i, q in enumerate(QUERIES)] + [(100, None), (101, "plan plan"), (102, "plan"), (103, "  harbour\tnotes ")]
    queries = spark.createDataFrame(asked, "query long, text string")
    for scope, part in (("all", 2 << 20), ("content", 20)):
        got = many_queries.search_table(files, queries, pol, k=7, scope=scope, pattern_bytes=part).collect()
        for number, text in asked:
            want = []
            if text and text.split():
                unique = " ".join(dict.fromkeys(text.split()))
                want = [(r.path, r.score) for r in search.search_files(files, unique, pol, scope=scope, limit=7).collect()]
            mine = [(r.path, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query == number]
            assert mine == want, (scope, text)


def test_very_many_queries_read_the_texts_once(spark, corpus):
    files, _, pol = corpus
    queries = spark.range(100_000).select(F.col("id").alias("query"), F.concat(F.lit("harbour word"), "id").alias("text")).union(
        spark.createDataFrame([(-1, "zebra")], "query long, text string"))
    got = many_queries.search_table(files, queries, pol, pattern_bytes=4 << 20).collect()
    assert [(r.query, r.rank) for r in got] == [(-1, 1)]
    assert many_queries.search_table(files, queries.limit(0), pol).collect() == []
    assert many_queries.search_table(files.limit(0), queries.limit(9), pol).collect() == []


def test_only_the_texts_of_a_piece_are_held_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rows = 1000
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int64)), pa.array(np.arange(rows, dtype=np.int32)), pa.array(["ab" * 50_000] * rows)],
                                       names=["block", "place", "text"])
    tracemalloc.start()
    try:
        made = gram_index._postings(iter([batch]))
        next(made)
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 60 << 20  # the texts are 100 MB


def test_matches_of_a_table_of_queries_are_not_stored(spark, corpus, monkeypatch):
    files, _, pol = corpus
    stored = []
    plain = many_queries.Steps.store

    def store(self, df, name):
        out = plain(self, df, name)
        stored.append((name, out.count()))
        return out

    monkeypatch.setattr(many_queries.Steps, "store", store)
    queries = spark.range(200).select(F.col("id").alias("query"), F.lit("d md").alias("text")).union(
        spark.range(200, 203).select("id", F.concat(F.lit("d "), F.col("id") % 3)))
    got = many_queries.search_table(files, queries, pol, k=2)
    assert got.where("query < 200").count() == 400
    assert all(n <= 4 * 2 * files.rdd.getNumPartitions() for name, n in stored if name != "query-terms"), stored


def test_the_best_files_of_many_sets_against_all_pairs(monkeypatch):
    import pickle

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(many_queries, "PAIRS", 50)
    monkeypatch.setattr(many_queries, "CELLS", 300)
    rng = random.Random(5)
    terms = [a + b for a in "abcd" for b in "abcd"]
    sets = [sorted(rng.sample(terms, rng.choice([1, 1, 2, 3, 5]))) for _ in range(80)]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    files = [(f"p{rng.randrange(10**6)}-{i}", rng.choice([None, -5, 0, 3]), t[:5], t) for i, t in enumerate(texts)]
    numbers = np.array([100 + i for i, s in enumerate(sets) for _ in s])
    shared = type("Shared", (), {"value": pickle.dumps((many_queries._automaton(terms), many_queries.Sets(
        numbers, np.array([terms.index(t) for s in sets for t in s]))))})
    weights = {"name": 7, "body": 2}
    batches = [pa.RecordBatch.from_pylist([dict(zip(("path", "mtime_ms", "_name", "_body"), f)) for f in files[at:at + 128]], schema=pa.schema(
        [("path", pa.string()), ("mtime_ms", pa.int64()), ("_name", pa.string()), ("_body", pa.string())])) for at in range(0, 300, 128)]
    made = pa.Table.from_batches(list(many_queries._scan(shared, weights, 4)(iter(batches)))).to_pylist()
    for i, asked in enumerate(sets):
        found = []
        for path, time, name, body in files:
            parts = [7 * (t in name) + 2 * (t in body) for t in asked]
            if all(parts):
                found.append((-sum(parts), -(time if time is not None else -2**63), path))
        assert [(-r["score"], -r["mtime_ms"], r["path"]) for r in made if r["number"] == 100 + i] == sorted(found)[:4]


def test_shares_of_the_sets_are_compared_with_one_scan(spark, corpus, monkeypatch):
    files, _, pol = corpus
    queries = spark.createDataFrame([*enumerate(QUERIES), (102, "plan"), (103, "  harbour\tnotes ")], "query long, text string")
    ranked = lambda **settings: sorted(map(tuple, many_queries.search_table(files, queries, pol, k=3, **settings).collect()))
    want, read = ranked(), []
    for name in ("_scan", "_postings"):
        plain = getattr(many_queries, name)
        monkeypatch.setattr(many_queries, name, lambda *args, name=name, plain=plain: read.append(name) or plain(*args))
    assert ranked(held=10) == want and len(want) > 10
    assert read == ["_postings"]
    assert ranked(held=10, pattern_bytes=12) == want


def test_files_that_cannot_be_among_the_best_are_not_compared(monkeypatch):
    import pickle

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(many_queries, "PAIRS", 50)
    compared = []
    plain = many_queries.Block.score
    monkeypatch.setattr(many_queries.Block, "score", lambda self, term, row: compared.append(len(row)) or plain(self, term, row))
    rng = random.Random(2)
    n = 20_000
    files = [(f"p{i:05}", rng.randrange(10**6), "alpha" if i % 5000 == 7 else "", "alpha beta gamma" if i % 3 else "beta alphabet gamma") for i in range(n)]
    shared = type("Shared", (), {"value": pickle.dumps((many_queries._automaton(["alpha", "beta g", "gamma"]), many_queries.Sets(np.array([1, 1, 2]), np.array([0, 2, 1]))))})
    schema = pa.schema([("path", pa.string()), ("mtime_ms", pa.int64()), ("_name", pa.string()), ("_body", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, f)) for f in files[at:at + 1000]], schema=schema) for at in range(0, n, 1000)]
    made = pa.Table.from_batches(list(many_queries._scan(shared, {"name": 40, "body": 5}, 4)(iter(batches)))).to_pylist()
    for number, score, held in ((1, lambda f: 10 + 40 * (f[2] != ""), lambda f: True), (2, lambda f: 5, lambda f: "beta g" in f[3])):
        best = sorted((-score(f), -f[1], f[0]) for f in files if held(f))[:4]
        assert [(-r["score"], -r["mtime_ms"], r["path"]) for r in made if r["number"] == number] == best
    assert sum(compared) < n / 4
