"""Every operator on the smallest tables or small fixtures, against a plain version."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from shelfmark.llm import archive, catalog, chat, hashing, lines, mixing, neardup, packing, quality, repeats, topk
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return catalog.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def check_packing(pieces, texts, window=2048):
    """Pieces cover every document once, sequences have no gaps; returns the padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(of) == {k for k, _ in texts}
    for key, text in texts:
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(of[key], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert bytes(p.token_ids) == ids[at:at + p.length].tobytes()
            at += p.length
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_packing_covers_every_token(docs, texts):
    assert check_packing(packing.pack(docs.repartition(3)).collect(), texts) == 0


def test_neighbours_share_telling_terms():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(100 * (i % 4), 100 * (i % 4) + 50, 40), 1).astype(np.uint16) for i in range(40)]
    index = packing.ShardIndex(docs, np.ones(packing.VOCABULARY, np.float32), 41.0, 16)
    for doc in range(4):
        unused = np.ones(40, bool)
        unused[doc] = False
        assert {int(x) % 4 for x in index.neighbours(doc, unused, most=9)} == {doc}
        unused[doc + 4] = False
        assert doc + 4 not in index.neighbours(doc, unused, most=9)


def test_windows_take_all_that_score_before_stored_order():
    """60 short texts of one topic lie among 60 of another; each window's first text shares its last term only with some."""
    docs = [np.array([*range(100 * (i % 2), 100 * (i % 2) + 20), 300 + i, 1], np.uint16) for i in range(120)]
    idf = np.ones(packing.VOCABULARY, np.float32)
    idf[300:] = 9
    packer = packing.Packer(22 * 60, 0)
    packer.shard(list(range(120)), docs, packing.ShardIndex(docs, idf, 22.0))
    windows = defaultdict(set)
    for doc_id, _, _, _, sequence, *_ in packer.done:
        windows[sequence].add(doc_id % 2)
    assert sorted(map(sorted, windows.values())) == [[0], [1]]


def test_neighbours_are_those_of_all_terms():
    """40 rare terms in common with nobody's company: only the commonest term is shared with the other documents."""
    docs = [np.array([*range(1000, 1040), 7, 1], np.uint16), np.array([*range(1000, 1040), 1], np.uint16)]
    docs += [np.array([2000 + i, 7, 1], np.uint16) for i in range(30)] + [np.array([1], np.uint16)]
    idf = np.ones(packing.VOCABULARY, np.float32)
    idf[7] = 0.01
    unused = np.arange(len(docs)) > 0
    assert packing.ShardIndex(docs, idf, 10.0).neighbours(0, unused).tolist() == list(range(1, 32))


def test_fast_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", " ", "<|endoftext|> a<|endoftext|>", "Öl 12\n\n x's", "日本語 emoji 😀", "a" * 5000, "\x00\u0085 ​", " " * 1_000_000):
        assert packing.token_ids(text, "byte_bpe_50k").tolist() == exact.encode(text, add_special_tokens=False).ids + [1]


def test_archive_round_trip(spark):
    body = "x" * 1000
    rows = [(1, "http://a/\r\nX: y", body), (5, "http://b", body), (3, None, body), (2, "u", "short"), (9, "u", "short"), (7, "u", None),
            (8, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = archive.write_archive(pages)
    assert kept.payloads.count() == 3
    got = {r.page_id: r for r in archive.read_archive(kept).collect()}
    for key, _, html in rows:
        assert bytes(got[key].payload) == (html or "").encode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), **{k: ("response", None) for k in (2, 9, 7, 8)}}
    assert bytes(got[2].record).endswith(b"Content-Length: 5\r\n\r\nshort\r\n\r\n")
    assert bytes(got[1].record).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n") and got[1].target == "http://a/%0D%0AX: y"


def test_altered_payload_is_noticed(spark):
    kept = archive.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"))
    wrong = archive.Archive(kept.headers, kept.payloads.withColumn("payload", F.encode(F.lit("abd"), "UTF-8")))
    with pytest.raises(Exception, match="does not fit"):
        archive.read_archive(wrong).collect()


def test_quality_held_out(spark, docs):
    known = catalog.table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    got = catalog.op3_nbsvm_quality(spark, "/root/testdata/sf0.01").join(known, "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_descent_meets_the_conditions_of_the_optimum():
    """A small problem against its conditions: margins beyond one have no weight, those within it have the full cost."""
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(60)]
    sign = np.where([len(r) > 0 and r[0] < 3 for r in rows], 1.0, -1.0)
    values = [np.ones(len(r)) for r in rows]
    weight, bias = quality.coordinate_descent(rows, values, sign, 1.0, 3000, 1e-9)
    best = sum(max(0, 1 - s * (weight[r].sum() + bias)) for r, s in zip(rows, sign)) + 0.5 * (weight @ weight + bias * bias)
    for _ in range(200):
        w, b = weight.copy(), bias + rng.normal() * 0.05
        w[:30] += rng.normal(size=30) * 0.05
        assert best <= sum(max(0, 1 - s * (w[r].sum() + b)) for r, s in zip(rows, sign)) + 0.5 * (w @ w + b * b) + 1e-6


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame(
        [(s, l, t, float(10 + 7 * i)) for i, (s, l, t) in enumerate((s, l, t) for s in "ab" for l in "xy" for t in "pq")],
        "source string, lang string, topic string, mass double")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}, "topic": 0.5}
    rows = mixing.rake(cells, targets, rate=0.1, rounds=12).collect()
    total = sum(r.mass for r in rows)
    by = defaultdict(float)
    for r in rows:
        by[r.source] += r.weight / total
        by[r.lang] += r.weight / total
    for key, share in {"a": 0.5, "b": 0.5, "x": 0.4, "y": 0.6}.items():
        assert by[key] == pytest.approx(share, abs=1e-6)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    for dims, spread in ((3, 1), (64, 4), (5, 10_000)):
        raw = np.round(rng.normal(size=(300, dims)) * spread, 2)
        raw[50:60] = raw[40]
        frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(raw)], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, rows_each=64, queries_each=3).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        whole = np.floor(256 * raw).astype(np.int64)
        for q in range(0, 300, 50):
            score = whole @ whole[q]
            order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:5]
            assert got[q] == [(i, score[i]) for i in order]


def test_top_k_with_large_components(spark):
    """Components beyond 2**28 after scaling, in queries and in rows; sums that doubles do not hold exactly."""
    rng = np.random.default_rng(6)
    raw = np.round(rng.normal(size=(120, 4)), 2)
    raw[[0, 7, 30, 31, 80]] *= 3e6
    raw[31, :2] = 1_048_577.0, -1_048_577.00390625
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(raw)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, rows_each=16, queries_each=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = [[int(x) for x in v] for v in np.floor(256 * raw)]
    for q in range(0, 120, 10):
        score = [sum(a * b for a, b in zip(v, whole[q])) for v in whole]
        assert got[q] == [(i, score[i]) for i in sorted(range(120), key=lambda i: (-score[i], i)) if i != q][:5]


def test_linked_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 32))
    raw = np.concatenate([c + 0.12 * rng.normal(size=(n, 32)) for c, n in zip(centres, [1] * 8 + [3, 20, 60, 200])])
    raw[-30:] = raw[-31]
    raw = raw[rng.permutation(len(raw))]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(raw)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in hashing.near_vectors(frame, block=32).collect()}
    unit = raw / np.linalg.norm(raw, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(raw), dtype=bool)
    sets = brute.Sets(range(len(raw)))
    for a, b in zip(*np.nonzero(near)):
        sets.join(int(a), int(b))
    found = sum(r.n_links for r in got.values())
    assert near.sum() > 5000 and 0.97 * near.sum() <= found <= near.sum()
    wrong = [i for i in got if got[i].component_id != sets.root(i)]
    assert len(wrong) <= 0.02 * len(raw)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_duplicates(docs, texts):
    expected = brute.near_components(texts, 85)
    for block in (256, 2):  # small blocks send every group through block pairs
        got = {r.doc_id: r for r in neardup.near_duplicates(docs, block=block).collect()}
        assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == expected
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(7)
    base = rng.integers(1, 2**63, 400, dtype=np.uint64)
    a, b = np.unique(base[:300]), np.unique(base[100:])
    alike = np.mean([np.mean(neardup.sketch(neardup.mix(a + x), 120) == neardup.sketch(neardup.mix(b + x), 120))
                     for x in rng.integers(1, 2**62, 40, dtype=np.uint64)])
    assert alike == pytest.approx(0.5, abs=0.04)
    assert len(set(neardup.sketch(a[:1], 120).tolist())) > 1  # one element fills every bin


def test_line_dedup(docs, texts, spark):
    extra = [(10_000, "one two three four five six seven eight nine"), (10_001, "one two three four FIVE six seven eight nine\nstays here"),
             (10_002, "one two three four five six seven eight\n\nalone"), (10_003, "a b"), (10_004, "a c"), (10_005, "a  b\n"),
             (10_006, "zero one two three four five six seven eight nine\nx"), (10_007, None), (10_008, ""), (10_009, "\n\n")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: r.text for r in lines.drop_lines(rows.repartition(3)).collect()}
    assert got == brute.without_lines(texts + extra, 8)


def test_repeats(docs, texts, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1 << 16)
    some = [t for t in texts if t[0] < 130]
    got = repeats.remove_repeats(docs.where("doc_id < 130").repartition(3), bucket_bytes=1 << 15).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute.without_repeats(some, 50)


def test_no_anchor_makes_one_large_group(docs, texts, monkeypatch):
    """A passage and a phrase shared by 300 documents in other surroundings: a chunk asks for at most ``crowd`` stretches of an anchor, and
    a group holds as many different parts of a core as there are surroundings of seven bytes."""
    monkeypatch.setattr(repeats, "CHUNK", 1 << 14)
    rng = np.random.default_rng(9)
    word = lambda n, of="abcdefghijklmnop": "".join(rng.choice(list(of), n))
    near = [word(7) for _ in range(5)]  # what stands next to the passage
    passage, phrase = word(120), word(40)
    extra = [(5000 + i, f"{word(60)}{near[i % 5]}{passage}{near[i % 3]}{word(60)}{phrase}{word(60)}") for i in range(300)]
    extra += [(None, word(60) + passage), (None, passage)] + extra[:3]
    some = [t for t in texts if t[0] < 30]
    rows = docs.where("doc_id < 30").select("doc_id", "text").union(docs.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    asked, crowd = (docs.sparkSession.sparkContext.accumulator(0) for _ in range(2))
    decide = repeats.decide

    def counted(part):
        anchors = np.concatenate([repeats.unplanes(x, 4) for x in part["anchors"]])
        asked.add(len(anchors))
        return decide(part)

    results = []
    for most in (1 << 30, 16):
        monkeypatch.setattr(repeats, "decide", counted)
        before = asked.value
        got = repeats.remove_repeats(rows.repartition(3), bucket_bytes=1 << 15, crowd=most).collect()
        results.append((sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), asked.value - before))
    assert results[0][0] == results[1][0]
    assert results[1][1] < results[0][1] - 300
    inner = repeats.compare

    def watched(least):
        def run(part):
            crowd.add(sum(len(cores) // 7 for cores in part["cores"]))
            return inner(least)(part)
        return run

    monkeypatch.setattr(repeats, "compare", watched)
    plain = brute.without_repeats([t for t in some + extra[:300]], 50)
    got = repeats.remove_repeats(rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3), bucket_bytes=1 << 15).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == plain
    assert crowd.value > 300


@pytest.mark.parametrize("least,k", [(50, 20), (30, 25), (60, 59), (140, 20)])
def test_parts_hold_every_string_of_a_stretch_with_its_core(least, k):
    """Strings of one part share its core, and every string lies in exactly one part."""
    rng = np.random.default_rng(12)
    texts = [bytes(rng.choice(list(b"abc"), n).tolist()) for n in (400, least, least - 1, 3 * least, 0, 700)]
    chunk = repeats.Chunk(np.arange(6).astype(np.int64).tobytes(), np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes(),
                          zstandard.ZstdCompressor().compress(b"".join(texts)), least, k, 16)
    entry, start, end, core = chunk.parts(np.arange(chunk.entries), least, k)
    covered = Counter((int(e), p) for e, s, t in zip(entry, start, end) for p in range(s, t - least + 1))
    wanted = Counter((e, p) for e in range(chunk.entries)
                     for p in range(chunk.start[chunk.lead[e]], chunk.end[chunk.lead[e]] - least + 1))
    assert covered == wanted
    # Equal strings have equal cores, wherever they stand.
    names = defaultdict(set)
    for s, t, c in zip(start, end, core):
        for p in range(s, t - least + 1):
            names[chunk.data[p:p + least].tobytes()].add(int(c))
    assert all(len(c) == 1 for c in names.values())


def test_maximal_repeats_of_a_text():
    """Every repeat of at least four bytes that cannot be extended, with all its places."""
    strings = [b"abcdefgh-xyz", b"--abcdefgh-", b"zabcdefxx", b"abcd"]
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    start = end - [len(s) for s in strings]
    place, string, common = repeats.enhanced_suffixes(data, start, end, 4)
    before = np.where(place > start[string], data[np.maximum(place - 1, 0)].astype(int), -1)
    groups = repeats.maximal_repeats(common, before, string, 4)
    found = {data[place[a]:place[a] + n].tobytes(): {(int(string[i]), int(place[i] - start[string[i]])) for i in range(a, b + 1)}
             for a, b, n, _ in groups}
    assert found == {b"abcd": {(0, 0), (1, 2), (2, 1), (3, 0)}, b"abcdef": {(0, 0), (1, 2), (2, 1)}, b"abcdefgh-": {(0, 0), (1, 2)}}


def test_chat_escapes_come_back(spark):
    said = ["<|turn|>", "<\\|turn|>", "a<\\\\|end|>\n", "</s>[INST] ok [/INST]", "<<SYS>>", "[\\INST]", "plain", "", None, "<|more|><|text|>"]
    rows = [(i % 3, i, ("user", "assistant", "assistant", None)[i % 4], t) for i, t in enumerate(said)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    done = chat.format_conversations(frame)
    for r in done.select("*", chat.read_turns(F.col("formatted")).alias("turns")).collect():
        mine = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == mine
        learned = [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
        assert len(learned) == sum(role == "assistant" for role, _ in mine)
        assert not any(mark in text for text in learned for mark in ("<|turn|>", "<|end|>", "</s>", "[INST]"))
    assert zlib.crc32(b"") == 0
