import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import claims, export, snapshot
from shelfmark.policy import RETRACT, VERDICTS, Root
from shelfmark.sources.sinks import VersionedTable
from shelfmark.streaming import jobs
from tests.test_claims_and_snapshots import SCHEMA, event


def feed(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_current_state_survives_late_and_out_of_order_events(spark, scratch):
    src, table = scratch + "/src", VersionedTable(spark, scratch + "/table")
    feed(spark, src, [event(1, "a", ts=10), event(2, "b", ts=10)])
    jobs.start_current(stream(spark, src), table, scratch + "/cp").awaitTermination()
    feed(spark, src, [event(3, "a", RETRACT, ts=30), event(4, "c", VERDICTS[1], ts=5)])
    feed(spark, src, [event(5, "a", VERDICTS[2], ts=20), event(6, "b", VERDICTS[3], ts=9)])  # older than what is known
    jobs.start_current(stream(spark, src), table, scratch + "/cp").awaitTermination()
    got = jobs.current_from_updates(table.read_all())
    want = claims.current_claims(spark.read.parquet(src))
    rows = lambda df: sorted(map(tuple, df.select(*claims.COLUMNS).collect()))
    assert rows(got) == rows(want) and {r["target"] for r in got.collect()} == {"b", "c"}


def test_repeats_are_dropped(spark, scratch):
    src = scratch + "/src"
    feed(spark, src, [event(1, "a", ts=100), event(1, "a", ts=100)])
    feed(spark, src, [event(1, "a", ts=100), event(2, "a", ts=101)])
    jobs.append_to(jobs.without_repeats(jobs.with_event_time(stream(spark, src))), scratch + "/out", scratch + "/cp").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(scratch + "/out").collect()) == [1, 2]


def test_daily_counts_wait_for_the_watermark(spark, scratch):
    src, day = scratch + "/src", 86_400
    feed(spark, src, [event(i, "a", ts=day * 10 + i) for i in range(3)] + [event(9, "a", ts=day * 12 + 5)])
    jobs.append_to(jobs.daily_counts(jobs.with_event_time(stream(spark, src))), scratch + "/out", scratch + "/cp").awaitTermination()
    assert [r["events"] for r in spark.read.parquet(scratch + "/out").collect()] == [3]


def test_ingest_finds_new_files_and_merges(spark, policy, scratch):
    root = Root(scratch + "/docs", "d")
    put = lambda rel, text: (os.makedirs(os.path.dirname(f"{root.path}/{rel}") or ".", exist_ok=True), open(f"{root.path}/{rel}", "w").write(text))
    put("a.md", "# A")
    put("node_modules/x.md", "no")
    table = VersionedTable(spark, scratch + "/table")
    jobs.start_ingest(spark, root, policy, table, scratch + "/cp").awaitTermination()
    put("sub/b.md", "# B\n\nlater")
    jobs.start_ingest(spark, root, policy, table, scratch + "/cp").awaitTermination()
    rows = snapshot.latest_version(table.read_all())
    assert {(r["rel"], r["title"]) for r in rows.collect()} == {("a.md", "A"), ("sub/b.md", "B")}


@pytest.fixture()
def export_setup(spark, policy, make_files, scratch):
    src = scratch + "/feed"
    manifest = export.attribute(spark.createDataFrame(
        [("/w", p, "user", None, None, None, None, None, None) for p in ("a.md", "b.md", "gone.md", "secret.md", "pic.png")],
        "root string, path string, role string, author string, original_date string, source_type string, parent_source_key string, source_title string, stable_id string")).drop("rejects")
    tables = {name: VersionedTable(spark, f"{scratch}/{name}") for name in ("ledger", "removals", "errors")}
    settings = dict(manifest=manifest, **tables, policy=policy, scope="agent:x")
    texts: dict[str, str] = {}

    def stored():
        rows = [("/w/" + k, len(v.encode()), v) for k, v in texts.items()]
        return spark.createDataFrame(rows, "path string, size long, text string")

    def add(items):
        texts.update({k: v if isinstance(v, str) else v["text"] for k, v in items.items()})
        make_files(items, pol=settings["policy"]).coalesce(1).write.mode("append").parquet(src)

    def run():
        schema = spark.read.parquet(src).schema
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.start_export(feed, scratch + "/cp", content=stored(), **settings).awaitTermination()

    return add, run, settings, texts, stored


def test_export_is_idempotent_and_keeps_versions(export_setup):
    add, run, settings, _, _ = export_setup
    add({"a.md": "one", "unlisted.md": "x", "gone.md": {"text": "g", "gone": True}, "secret.md": "k"})
    run()
    add({"a.md": "one", "gone.md": {"text": "g", "gone": True}})  # the same again
    run()
    add({"a.md": "two", "b.md": "new"})
    run()
    book = settings["ledger"].read_all()
    assert book.count() == 3 and book.select("source_key").distinct().count() == 3
    assert book.select("stable_id").distinct().count() == 2
    assert settings["removals"].read_all().count() == 1


def test_a_bad_document_does_not_hold_up_the_others(export_setup, spark):
    add, run, settings, texts, _ = export_setup
    add({"a.md": "one", "pic.png": {"text": "", "size": 9}, "b.md": {"text": "short", "size": 500}, "secret.md": {"text": "k", "denied": True}})
    texts["pic.png"] = "x\x00" * 5
    run()
    assert settings["ledger"].read_all().count() == 1
    failed = jobs.open_errors(settings["errors"], settings["ledger"])
    assert {(r["rel"], r["reason"]) for r in failed.collect()} == {("pic.png", "size-mismatch"), ("b.md", "size-mismatch")} | (
        {("secret.md", "denied")} if settings["policy"].deny_globs and failed.where("rel = 'secret.md'").count() else set())
    feed = spark.createDataFrame([("/w", "a.md", 4), ("/w", "b.md", 7), ("/w", "c.md", 9)], "root string, rel string, scan_id long")
    assert jobs.held_cursor(feed, failed).first()["cursor"] == 6
    add({"b.md": "short"})  # listed again, now with its true size
    run()
    assert settings["ledger"].read_all().count() == 2
    left = jobs.open_errors(settings["errors"], settings["ledger"])
    assert "b.md" not in {r["rel"] for r in left.collect()}
    assert jobs.held_cursor(feed, left).first()["cursor"] == 9


def test_export_sends_whole_texts(export_setup):
    """The index cuts bodies and takes front matter off; the export sends what is stored."""
    add, run, settings, texts, _ = export_setup
    settings["policy"] = settings["policy"].with_(max_body_chars=50)
    long = "---\ntitle: t\n---\n" + "word " * 100
    add({"a.md": long})
    run()
    rows = settings["ledger"].read_all().collect()
    sent = "".join(m["text"] for r in sorted(rows, key=lambda r: r["part_index"]) for m in json.loads(r["payload_json"])["messages"])
    assert sent == long


def test_one_row_per_key_in_a_batch(export_setup, make_files):
    _, _, settings, texts, stored = export_setup
    texts["a.md"] = "one"
    twice = make_files({"a.md": "one"})
    jobs.export_batch(twice.union(twice), 0, content=stored(), **settings)
    assert settings["ledger"].read_all().count() == 1


def test_a_repeated_micro_batch_adds_nothing(export_setup, make_files):
    _, _, settings, texts, stored = export_setup
    texts.update({"a.md": "one", "gone.md": "g"})
    batch = make_files({"a.md": "one", "gone.md": {"text": "g", "gone": True}})
    for _ in range(2):
        jobs.export_batch(batch, 0, content=stored(), **settings)
        jobs.export_batch(batch, 1, content=stored(), **settings)
    assert settings["ledger"].read_all().count() == 1 and settings["removals"].read_all().count() == 1
    assert settings["ledger"].read_all().select(F.max("attempts")).first()[0] == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_streams_read_a_table_stored_as_a_file_as_a_folder_or_empty(spark, scratch):
    from shelfmark.plans import catalog

    given = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{given}/events.parquet")
    events.repartition(3).write.parquet(f"{scratch}/folder/events.parquet")
    events.limit(0).write.parquet(f"{scratch}/none/events.parquet")
    rows = lambda name, where: sorted(map(repr, catalog.QUERIES[name](spark, where).collect()))
    for name in ("stream_current_claims", "stream_daily_counts", "stream_without_repeats"):
        want = rows(name, given)
        assert want and rows(name, f"{scratch}/folder") == want
        assert rows(name, f"{scratch}/none") == []


def test_a_micro_batch_shuffles_the_texts_of_its_documents_only(export_setup, spark, make_files, scratch):
    _, _, settings, texts, _ = export_setup
    body = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(4000))
    texts["a.md"] = "one"
    others = spark.range(40).select(F.concat(F.lit("/w/other-"), "id").alias("path"), F.lit(len(body)).cast("long").alias("size"), F.concat(F.lit(body), "id").alias("text"))
    content = others.union(spark.createDataFrame([("/w/a.md", 3, "one")], "path string, size long, text string"))
    content.write.parquet(scratch + "/content")
    content, batch = spark.read.parquet(scratch + "/content"), make_files({"a.md": "one"})
    wanted = batch.select(F.xxhash64("path").alias("key"))
    assert [r["path"] for r in jobs.thinned(content, F.xxhash64("path"), wanted).collect()] == ["/w/a.md"]
    plans = []
    plain = VersionedTable.write

    def write(table, df, number):
        plans.append((table.path, df._jdf.queryExecution().optimizedPlan().toString()))
        plain(table, df, number)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(VersionedTable, "write", write)
        jobs.export_batch(batch, 0, content=content, **settings)
    assert settings["ledger"].read_all().count() == 1
    # Keys are grouped and compared without the payloads; errors are told without the texts.
    assert not any("payload_json" in line for path, plan in plans if path.endswith("_plan") for line in plan.splitlines() if "Project" in line or "Aggregate" in line)
    assert not any("first(payload_json" in plan for _, plan in plans)
