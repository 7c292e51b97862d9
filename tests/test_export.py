"""Segmentation and packing against brute force, the ledger against a step-by-step replay."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import keys
from shelfmark.functions.text import prefix_sums
from shelfmark.operators import export, ledger, snapshot
from shelfmark.sources import documents, sinks

TEXTS = [
    "项目台账。" * 300, "👩🏽‍💻👍🏿" * 200, "𠮷𡃁" * 150, 'say "x"\\ \n\ttab' * 120, "éä" * 200, "", "\n", "\n\n \n", "a", "\n\na\n\nb",
    "a\n \nb\n\n\nc\n", "a\n\n   ", "x" * 1201, "one. two! three? " * 90, "　\n\na", "a\r\n\r\nb",
]


def brute_paragraphs(text):
    """Line by line: a paragraph ends behind the blank lines that follow it."""
    out, current, seen, ended = [], "", False, False
    for line in text.splitlines(keepends=True) if "\r" not in text else [p + "\n" for p in text.split("\n")[:-1]] + [text.split("\n")[-1]]:
        blank = line.strip() == ""
        if seen and ended and not blank:
            out.append(current)
            current, ended = "", False
        current += line
        if blank and seen:
            ended = True
        if not blank:
            seen = True
    return out + ([current] if current or not out else [])


def brute_cut(text, budget):
    out = []
    while len(text) > budget:
        low = max(1, budget - budget // 4)
        at = next((j for j in range(budget, low, -1) if text[j - 1] in "\n。！？；.!?;"), budget)
        out.append(text[:at])
        text = text[at:]
    return out + [text]


def brute_parts(text, budget):
    return [piece for p in brute_paragraphs(text) for piece in (brute_cut(p, budget) if len(p) > budget else [p])]


def parts_of(spark, policy, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    return {r["i"]: r["parts"] for r in export.segment(rows, policy).collect()}


def check(parts, text, budget):
    assert "".join(p["text"] for p in parts) == text
    assert [p["text"] for p in parts] == brute_parts(text, budget)
    assert all(text[p["start_cp"]:p["end_cp"]] == p["text"] and len(p["text"]) <= budget for p in parts)
    assert [p["ordinal"] for p in parts] == list(range(len(parts)))


@pytest.mark.parametrize("budget", [500, 37])
def test_segments_equal_brute_force(spark, policy, budget):
    got = parts_of(spark, policy.with_(segment_chars=budget), TEXTS)
    for i, text in enumerate(TEXTS):
        check(got[i], text, budget)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t.。𠮷　", max_size=80), min_size=20, max_size=20))
def test_segments_of_random_texts(spark, policy, texts):
    got = parts_of(spark, policy.with_(segment_chars=9), texts)
    for i, text in enumerate(texts):
        check(got[i], text, 9)


def test_locators(spark, policy):
    got = parts_of(spark, policy.with_(segment_chars=4), ["ab\n\nabcdefghi\n\nc"])[0]
    assert [p["locator"] for p in got] == [
        "paragraph-1", "paragraph-2+part-1/3", "paragraph-2+part-2/3", "paragraph-2+part-3/3", "paragraph-3"]
    assert [p["id"] for p in got] == [f"p{i:04d}" for i in range(5)]


def test_prefix_sums(spark):
    values = [random.Random(1).randint(0, 9) for _ in range(1000)]
    df = spark.createDataFrame([(values,), ([],), ([5],)], "v array<int>")
    got = [r[0] for r in df.select(prefix_sums(F.col("v"), 16)).collect()]
    want = [sum(values[: i + 1]) for i in range(1000)]
    assert got == [want, [], [5]]


def attributed(spark, rows):
    raw = spark.createDataFrame(
        rows, "root string, rel string, name string, body string, role string, author string, original_date string, "
              "source_type string, parent_source_key string, source_title string, stable_id string")
    return export.attribute(raw)


def doc(rel, body, role=None, author=None, date=None, kind=None, parent=None, title=None, sid=None):
    return ("/w", rel, rel.rsplit("/", 1)[-1], body, role, author, date, kind, parent, title, sid)


def test_batches_respect_limits_and_order(spark, policy):
    body = "\n\n".join(f'第{i}段 "quoted" \\ text' * (i % 7 + 1) for i in range(260)) + "\n\n" + "长" * 13_000
    rows = export.build_payloads(attributed(spark, [doc("a.md", body, "user", "me", "2024-01-02")]), policy, "agent:x").orderBy("part_index").collect()
    texts, sizes = [], []
    for r in rows:
        payload = json.loads(r["payload_json"])
        encoded = len(json.dumps(payload["messages"], ensure_ascii=False, separators=(",", ":")).encode())
        assert 1 <= len(payload["messages"]) <= 100 and encoded <= 24_000
        assert set(payload["source_metadata"]) == {"original_ref", "parser_version", "locator", "author", "original_date"}
        texts += [m["text"] for m in payload["messages"]]
        sizes.append((len(payload["messages"]), encoded))
    assert "".join(texts) == body
    # greedy: the first message of a batch would not have fitted into the batch before
    for (n, size), nxt in zip(sizes, rows[1:]):
        first = json.dumps(json.loads(nxt["payload_json"])["messages"][0], ensure_ascii=False, separators=(",", ":")).encode()
        assert n == 100 or size + 1 + len(first) > 24_000
    assert [r["source_key"][-6:] for r in rows] == [f"#p{i + 1:04d}" for i in range(len(rows))]
    assert export.validate_payloads(export.build_payloads(attributed(spark, [doc("a.md", body)]), policy, "agent:x"), policy).where(
        F.size("problems") > 0).count() == 0
    unknown = export.build_payloads(attributed(spark, [doc("a.md", "x")]), policy, "agent:x").select(export.unknown_keys(F.col("payload_json")))
    assert unknown.first()[0] == []


def test_version_hash_follows_every_field(spark, policy):
    base = doc("a.md", "text", "user", "me", "2024-01-02")
    variants = [base, doc("a.md", "text2", "user", "me", "2024-01-02"), doc("a.md", "text", "external", "me", "2024-01-02"),
                doc("a.md", "text", "user", "you", "2024-01-02"), doc("a.md", "text", "user", None, "2024-01-02"), doc("a.md", "text", "user", "me")]
    hashes = [r[0] for r in export.with_identity(attributed(spark, variants), policy).select("version_hash").collect()]
    assert len(set(hashes)) == len(variants)
    other = export.with_identity(attributed(spark, [base]), policy.with_(parser_version="other")).first()["version_hash"]
    assert other not in hashes
    absent_vs_empty = spark.range(1).select(keys.version_hash({"author": F.lit("")}), keys.version_hash({})).first()
    assert absent_vs_empty[0] != absent_vs_empty[1]


def test_identity_of_known_strings(spark, policy):
    import hashlib

    row = export.with_identity(attributed(spark, [doc("./d\\a.md", "x")]), policy).first()
    assert row["stable_id"] == hashlib.sha256(b"/w\nd/a.md").hexdigest()[:16]
    given_id = export.with_identity(attributed(spark, [doc("a.md", "x", sid="abc")]), policy).first()
    assert given_id["stable_id"] == "abc" and given_id["base_source_key"].startswith("corpus:abc:")
    assert spark.range(1).select(keys.ordinal(F.lit(12345))).first()[0] == "p12345"


def test_attribution(spark):
    rows = attributed(spark, [
        doc("1", "x"), doc("2", "x", role="editor"), doc("3", "x", author=" N/A "), doc("4", "x", date="2024-02-30"), doc("5", "x", kind="imported_summary"),
        doc("6", "x", kind="imported_summary", parent="k"), doc("7", "x", date="24-1-1"), doc("8", "x", kind="poem")]).collect()
    assert [r["rejects"] for r in rows] == [[], ["role"], ["placeholder-author"], ["original-date"], ["summary-without-parent"], [], ["original-date"], ["source-type"]]
    assert (rows[0]["role"], rows[0]["author"], rows[0]["source_type"]) == ("external", None, "document")


def test_submitting_twice_changes_nothing_and_conflicts_show(spark, policy):
    docs = attributed(spark, [doc("a.md", "one"), doc("b.md", "two")])
    payloads = export.build_payloads(docs, policy, "agent:x")
    empty = payloads.limit(0).select("instance", "source_key", "payload_digest", F.lit("").alias("stage"))
    book = ledger.new_submissions(ledger.plan_submissions(payloads, empty))
    assert book.count() == 2
    again = ledger.plan_submissions(payloads, book)
    assert ledger.new_submissions(again).count() == 0 and {r["decision"] for r in again.collect()} == {"retry"}
    changed = payloads.withColumn("payload_digest", F.lit("other"))
    assert ledger.plan_submissions(changed, book).where("decision = 'conflict'").count() == 2
    done = book.withColumn("stage", F.lit("receipted"))
    assert {r["decision"] for r in ledger.plan_submissions(payloads, done).collect()} == {"skip"}


def test_results_fold_like_a_replay(spark, policy):
    rng = random.Random(7)
    rows = [("i", "sid", "v", f"k{k}", 0, 1, None, "d", "s", "document", "user", "{}", "pending", None, None, 0, None, None) for k in range(30)]
    book = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ledger.SUBMISSIONS.fields))
    events = [("i", f"k{rng.randrange(30)}", s, rng.choice(["submitted", "receipted", "indexed", "failed", "counted"]), f"s{s}" if s % 3 == 0 else None, None,
               f"m{s}", "tool") for s in range(200)]
    want = {f"k{k}": ["pending", 0, None, None] for k in range(30)}
    rank = {"receipted": 1, "indexed": 2}
    for _, key, seq, event, sid, _, message, _ in events:
        row = want[key]
        if event in ("submitted", "failed", "counted"):
            row[1] += 1
            row[3] = None if event == "submitted" else message
        if event in rank:
            row[0] = event if rank[event] >= rank.get(row[0], 0) else row[0]
        elif event in ("submitted", "failed") and row[0] not in rank:
            row[0] = event
        row[2] = sid or row[2]
    ev = spark.createDataFrame(events, "instance string, source_key string, seq long, event string, source_id string, job_id string, message string, kind string")
    got = {r["source_key"]: [r["stage"], r["attempts"], r["source_id"], r["last_error"]] for r in ledger.apply_results(book, ev).collect()}
    assert got == want
    assert ledger.exhausted(ledger.apply_results(book, ev), 5).where("stage in ('receipted', 'indexed')").count() == 0


def test_receipts_at_any_depth(spark):
    inner = json.dumps({"source_id": "S1", "jobId": "J1"})
    nested = json.dumps({"content": [{"type": "text", "text": inner}]})
    rows = spark.createDataFrame([(inner,), (nested,), (json.dumps({"r": nested}),), ("{}",)], "response string")
    assert [(r["source_id"], r["job_id"]) for r in ledger.receipts(rows).collect()] == [("S1", "J1")] * 3 + [(None, None)]


def test_result_kinds(spark):
    rows = [(None, False, False, ""), (200, False, False, ""), (403, False, False, ""), (429, False, False, ""), (503, False, False, ""), (422, False, False, ""),
            (200, True, False, "Scope not allowed"), (200, True, False, "bad"), (200, False, True, "no permission"), (200, False, True, "full")]
    df = spark.createDataFrame(rows, "status int, rpc_error boolean, tool_error boolean, message string")
    assert [(r["kind"], r["action"]) for r in ledger.classify_results(df).collect()] == [
        ("unknown", "count"), (None, "receipt"), ("auth", "stop"), ("transient", "count"), ("transient", "count"), ("validation", "fail"),
        ("auth", "stop"), ("validation", "fail"), ("auth", "stop"), ("tool", "fail")]


def test_manifest(spark, scratch):
    good = {"scope": "agent:box-1", "sources": [{"path": "a.md", "role": "user"}, {"path": "../b"}, {"path": "/c"}, {"path": "d", "colour": "red"},
                                               {"path": "e"}, {"path": "e"}, {"path": " "}, {"path": "f", "author": "unknown"}]}
    path = scratch + "/m.json"
    with open(path, "w") as f:
        json.dump(good, f)
    head, ok, bad = documents.read_manifest(spark, path, "/w")
    assert head == {"scope": "agent:box-1", "instance": "default", "root": "/w"}
    assert [(r["path"], r["root"], r["role"]) for r in ok.collect()] == [("a.md", "/w", "user")]
    assert {(r["path"], tuple(r["rejects"])) for r in bad.collect()} == {
        ("../b", ("path-goes-up",)), ("/c", ("path-not-relative",)), ("d", ("unknown-key",)), ("e", ("path-repeated",)), ("", ("path-missing",)),
        ("f", ("placeholder-author",))}
    for broken in ({"scope": "box", "sources": [{"path": "a"}]}, {"scope": "agent:x", "sources": []}):
        with open(path, "w") as f:
            json.dump(broken, f)
        with pytest.raises(ValueError):
            documents.read_manifest(spark, path)


def test_write_batches_keeps_bytes(spark, policy, scratch):
    payloads = export.build_payloads(attributed(spark, [doc("a.md", 'line "1"\n\n行 2')]), policy, "agent:x")
    sinks.write_batches(payloads, scratch + "/out")
    assert spark.read.text(scratch + "/out").select(F.sha2("value", 256)).first()[0] == payloads.first()["payload_digest"]


def test_allow_list_and_feed(make_files, spark):
    files = make_files({"a.md": {"text": "x", "scan_id": 5}, "b.md": {"text": "y", "scan_id": 7, "gone": True}, "c.md": {"text": "z", "scan_id": 9}})
    allow = spark.createDataFrame([("/w", "a.md"), ("/w", "b.md")], "root string, path string")
    feed = snapshot.change_feed(files, 4, allow)
    assert {(r["rel"], r["change"]) for r in feed.collect()} == {("a.md", "live"), ("b.md", "removed")}
    assert snapshot.next_cursor(feed, 4).first()[0] == 7
    assert snapshot.next_cursor(snapshot.change_feed(files, 9), 9).first()[0] == 9
