"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import archive, chat, hashing, lines, mixing, neardup, packing, quality, repeats, topk

LONG = "wide and deep " * 40_000
CLASH = ("rep", "low", "drops", "_score", "_told", "_place", "_mix_kept", "component", "slot", "first", "bands", "n",
                               "ids", "_kept", "mass")
def clash(df):
    return df.withColumns({c: F.lit(c) for c in CLASH})


PROSE = "the quick brown fox jumps over the lazy dog near the old river bank while it rains"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PROSE, "en", "a", 5), (1, PROSE, "en", "a", 5), (2, PROSE, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0),
            (None, PROSE, "en", "a", 5), (None, None, None, None, None), (5, LONG, "fr", "a", 1), (6, "\n \t\n", "en", "b", 4),
            (7, PROSE + " again", "en", "a", 5)]
    return clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))


ALL = [1, 1, 2, 3, 4, 5, 6, 7, None, None]


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 2 * next(r.doc_tokens for r in got if r.doc_id == 1)
    assert sum(r.length for r in got if r.doc_id in (3, 4)) == 2
    assert packing.pack(none).collect() == []


def test_repeats(docs, none):
    got = repeats.remove_repeats(docs).collect()
    assert ids(got) == ALL
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[1].n_removed == 0 and of[2].n_removed == len(PROSE) and of[7].n_removed == len(PROSE)
    assert of[3].n_bytes == 0 and of[5].n_bytes == len(LONG) and of[5].n_removed == 0
    assert [r.n_removed for r in got if r.doc_id is None and r.n_bytes] == [len(PROSE)]
    assert repeats.remove_repeats(none).collect() == []


def test_near_duplicates(docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert ids(got) == ALL
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[2].component_id == 1 and not of[2].kept and of[1].kept and of[7].component_id == 1
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert of[3].n_shingles == of[6].n_shingles == 0 and of[3].kept and of[6].kept
    assert neardup.near_duplicates(none).collect() == []


def test_lines(docs, none):
    done = lines.drop_lines(docs)
    assert done.columns == docs.columns
    got = done.collect()
    assert ids(got) == [1, 1, 3, 4, 5, 6, None]  # copies and the near line lost all they had
    assert {r.text for r in got if r.doc_id == 3} == {None} and {r.drops for r in got} == {"drops"}
    assert lines.drop_lines(none).collect() == []


def test_mixing(docs, none):
    got = mixing.mix(docs, prefix="mine_").collect()
    assert ids(got) == ALL and all(0 <= r.mine_probability <= 1 for r in got) and {r._kept for r in got} == {"_kept"}
    assert {r.mine_source for r in got if r.source is None} == {"unknown"}
    assert mixing.mix(none, prefix="mine_").collect() == []


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (1, 0), (4, 0)], "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        score = quality.scorer(spark, quality.fit_quality(docs, known))
        got = docs.select("doc_id", score(F.col("text")).alias("score")).collect()
        assert ids(got) == ALL and all(0 <= r.score <= 1 for r in got)
        assert none.select(score(F.col("text")).alias("score")).collect() == []


def test_archive(spark):
    rows = [(1, "u", "x" * 2000), (1, "u", "x" * 2000), (None, None, "x" * 2000), (2, "u", None), (None, "u", "y" * 2000)]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = archive.digest_archive(archive.read_archive(archive.write_archive(pages))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [
        (0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "response", 0)]
    assert archive.read_archive(archive.write_archive(pages.where("false"))).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.01]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (None, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0])]
    return clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))


def test_vectors_near(vectors):
    got = hashing.near_vectors(vectors).collect()
    assert len(got) == 13
    of = {r.vec_id: r for r in got}
    assert {i: of[i].n_links for i in (2, 3, 4, 5, 6, 7, 9, 10, None)} == dict.fromkeys((2, 3, 4, 5, 6, 7, 9, 10, None), 0)
    assert of[0].n_links == 3 and of[1].component_id == of[8].component_id == 0 and of[None].kept
    assert hashing.near_vectors(vectors.where("false")).collect() == []


def test_vectors_top(vectors):
    got = topk.top_k(vectors, F.col("vec_id") % 8 == 0, k=3).collect()
    asked = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (0, 8)}
    assert asked[0] == [(1, 65536), (8, 65536), (8, 65536)] and asked[8] == [(0, 65536), (1, 65536), (4, 0)]
    assert topk.top_k(vectors.where("false"), F.col("vec_id") % 8 == 0).collect() == []


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", LONG), (2, 1, "assistant", "")]
    frame = clash(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_conversations(frame)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 0), None: (1, len(LONG)), 2: (1, 0)}
    assert chat.digest_conversations(chat.format_conversations(frame.where("false"))).collect() == []


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, none):
            done = stage(spark, given, str(tmp_path))
            rows = done.collect()
            assert bool(rows) == (given is docs), name
            if name != "pack_sequences":
                assert done.columns == given.columns


def test_pipeline_keeps_one_row_of_a_group(spark, docs, tmp_path):
    """Repeated rows and rows without an id are members of their group as well."""
    done = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert done.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in done.collect()) == [
        (False, 1, "the q"), (False, 3, ""), (False, 4, ""), (False, 5, "wide "), (False, 6, "\n \t\n"), (True, 0, "")]
    alone = spark.createDataFrame([(None, PROSE), (None, PROSE), (None, PROSE.upper())], "doc_id long, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, alone, str(tmp_path)).count() == 1


def test_lines_of_very_many_rows_without_an_id(spark):
    """Rows that share an id, or have none, have a list of their own: the work grows with the rows, not with their square."""
    text = "\n".join(f"line {i} of a document that many others hold a part of" for i in range(0, 6000, 2))
    rows = spark.range(8000).select(F.lit(None).cast("long").alias("doc_id"), F.expr(
        "concat('line ', cast(id % 6000 AS string), ' of a document that many others hold a part of\nown ', cast(id AS string))").alias("text"))
    done = lines.drop_lines(spark.createDataFrame([(1, text)], "doc_id long, text string").union(rows).union(rows.limit(1).crossJoin(spark.range(500)).drop("id")))
    got = [r.text for r in done.where("doc_id IS NULL").collect()]
    assert len(got) == 8500 and all(t.startswith("own ") for t in got)  # odd lines are one word off an even one
    assert done.where("doc_id = 1").first().text == text.split("\n")[0]


def test_records_name_themselves_and_are_cut_by_their_lengths(spark):
    rows = [(1, "u", "x" * 2000, 1_700_000_000), (1, "u", "x" * 2000, None), (None, None, "x" * 2000, None), (2, "u", None, 0), (3, "u", "é\r\n\r\n" * 90_000, 1)]
    pages = clash(spark.createDataFrame(rows, "page_id long, url string, html string, at long")).withColumn("at", F.timestamp_seconds("at"))
    got = archive.read_archive(archive.write_archive(pages, date="2020-01-02T03:04:05Z", date_column="at")).collect()
    heads = [bytes(r.record).split(b"\r\n\r\n")[0].decode() for r in got]
    named = [next(line for line in h.split("\r\n") if line.startswith("WARC-Record-ID: ")) for h in heads]
    assert len(set(named)) == 5
    targets = {line.split(": ")[1] for h in heads for line in h.split("\r\n") if line.startswith("WARC-Refers-To")}
    assert targets <= {n.split(": ")[1] for n in named} and targets
    assert sorted(r.date for r in got) == ["1970-01-01T00:00:00Z", "1970-01-01T00:00:01Z", "2020-01-02T03:04:05Z", "2020-01-02T03:04:05Z", "2023-11-14T22:13:20Z"]
    for r in got:
        raw = bytes(r.record)
        head, rest = raw.split(b"\r\n\r\n", 1)
        size = int(head.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
        block = rest[:size]
        assert rest[size:] == b"\r\n\r\n"
        if r.record_type == "response":
            assert block.split(b"\r\n\r\n", 1)[1] == bytes(r.payload) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        else:
            assert block == b""
    cut = spark.createDataFrame([(bytes(got[0].record)[:-5],), (b"no record",), (b"",), (None,)], "record binary").select(archive.cut_payload(F.col("record")).alias("p"))
    assert {r.p for r in cut.collect()} == {None}


def test_mixing_leaves_columns_with_its_names_alone(spark, tmp_path):
    """The registered query on a table that has all the names it would give."""
    from shelfmark.llm import catalog

    names = ("_p", "_source", "_LANG", "_topic", "_tokens", "_probability", "_kept", "__p", "_mix_kept")
    rows = [(i, f"some words {i}", "en" if i % 2 else None, "a", i) for i in range(20)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain.write.parquet(f"{tmp_path}/plain/documents.parquet")
    plain.withColumns({c: F.lit(c) for c in names}).write.parquet(f"{tmp_path}/named/documents.parquet")
    a, b = ([tuple(r) for r in catalog.op4_raked_mixture(spark, f"{tmp_path}/{d}").orderBy("doc_id").collect()] for d in ("plain", "named"))
    assert a == b and len(a) == 20
    kept = mixing.mix(plain.withColumns({c: F.lit(c) for c in names})).collect()
    assert {r["_p"] for r in kept} == {"_p"} and {r["_kept"] for r in kept} == {"_kept"}


def test_only_texts_that_can_lose_a_line_are_hashed(monkeypatch):
    import pyarrow as pa

    same = [lines.may_repeat(t) for t in (None, "", "a", "a\nb", "\n\n", "a\n\nb\n ", "a b\nc\na  b", "x\t\n x", "ab c\na bc")]
    assert same == [False] * 6 + [True] * 3
    seen = []
    plain = lines.Lines

    def counted(texts):
        seen.extend(texts)
        return plain(texts)

    monkeypatch.setattr(lines, "Lines", counted)
    low, high = plain([b"gone here"]).names()
    listed = [[int(low[0]), int(high[0])]]
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("told", pa.list_(pa.list_(pa.int64())))])
    rows = [(1, "one\ntwo", None), (2, "x y\nb\nx  y", None), (3, "gone  here\nstays", listed), (4, "gone here", listed), (5, None, None), (6, "ab c\na bc", None)]
    batch = pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], schema=kind)
    done = next(lines.cut_lines("told")(iter([batch]))).to_pylist()
    assert [(r["text"], r["told"]) for r in done] == [
        ("one\ntwo", False), ("x y\nb", False), ("stays", False), ("", True), (None, False), ("ab c\na bc", False)]
    assert seen == [b"x y\nb\nx  y", b"gone  here\nstays", b"gone here", b"ab c\na bc"]
