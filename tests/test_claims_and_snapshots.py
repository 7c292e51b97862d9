import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import claims, snapshot
from shelfmark.policy import RETRACT, VERDICTS
from shelfmark.sources import sinks

SCHEMA = ("id long, kind string, target_type string, target string, verdict string, note string, source_ref string, holder string, "
          "signed_by string, actor_type string, authority string, ts long")


def event(i, target, verdict=VERDICTS[0], ts=None, actor="human", **over):
    row = dict(id=i, kind="judgment", target_type="file", target=target, verdict=verdict, note="", source_ref="r", holder="h", signed_by="s", actor_type=actor,
               authority="L1" if actor == "human" else "L0", ts=i if ts is None else ts)
    return tuple({**row, **over}.values())


@pytest.fixture()
def log(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def state(df):
    return {r["target"]: r["verdict"] for r in df.collect()}


def test_retraction_does_not_uncover_older_verdicts(log):
    df = log([event(1, "a"), event(2, "a", VERDICTS[1]), event(3, "a", RETRACT), event(4, "b"), event(5, "c", RETRACT), event(6, "c", VERDICTS[2])])
    assert state(claims.current_claims(df)) == {"b": VERDICTS[0], "c": VERDICTS[2]}
    # negative control: filtering before ranking brings the old verdict of a back
    wrong = claims.latest_event(df.where(F.col("verdict") != RETRACT))
    assert state(wrong) != state(claims.current_claims(df)) and state(wrong)["a"] == VERDICTS[1]


def test_same_second_is_decided_by_id(log):
    df = log([event(9, "a", VERDICTS[3], ts=100), event(8, "a", VERDICTS[0], ts=100), event(10, "a", VERDICTS[1], ts=99)])
    assert state(claims.current_claims(df)) == {"a": VERDICTS[3]}


def test_machine_note_hides_unless_asked_for_humans(log):
    df = log([event(1, "a"), event(2, "a", None, actor="machine")])
    assert state(claims.current_claims(df)) == {"a": None}
    assert state(claims.current_claims(df, human_only=True)) == {"a": VERDICTS[0]}


@pytest.mark.parametrize("over,reason", [
    ({}, None), ({"signed_by": "  "}, "missing:signed_by"), ({"kind": "poem"}, "unknown:kind"), ({"target_type": "x"}, "unknown:target_type"),
    ({"actor_type": "cat"}, "unknown:actor_type"), ({"authority": "L9"}, "unknown:authority"), ({"verdict": "?"}, "unknown:verdict"),
    ({"actor_type": "machine", "authority": "L1", "verdict": None}, "machine-above-L0"), ({"actor_type": "machine", "authority": "L0"}, "verdict-needs-human"),
    ({"verdict": ""}, None), ({"verdict": None}, None), ({"source_ref": None}, "missing:source_ref")])
def test_validation(log, over, reason):
    assert claims.check_claims(log([event(1, "a", **over)])).first()["reject_reason"] == reason


def test_append_keeps_the_log_and_returns_rejects(log, spark, scratch):
    path = scratch + "/log"
    assert sinks.append_claims(log([event(1, "a")]), path).count() == 0
    assert sinks.append_claims(log([event(2, "a", RETRACT), event(3, "b", signed_by="")]), path).count() == 1
    assert [r["id"] for r in claims.history(spark.read.parquet(path), "a").collect()] == [2, 1]


def test_summary_and_pending(log, policy):
    df = log([event(1, "a"), event(2, "b", None, actor="machine"), event(3, "c", RETRACT), event(4, "a", None, actor="machine"), event(5, "d", None, actor="machine"),
              event(6, "d", VERDICTS[1]), event(7, "e", None, actor="machine"), event(8, "e", RETRACT)])
    row = claims.claims_summary(df).first()
    assert (row["events"], row["current_targets"], row["unjudged"], row["machine_notes"], row["human_claims"], row["retracted_targets"], row["verdict_1"]) == (8, 3, 2, 4, 4, 2, 1)
    assert {r["target"]: r["id"] for r in claims.pending_notes(df).collect()} == {"a": 4, "b": 2, "e": 7}
    empty = claims.claims_summary(df.limit(0)).first()
    assert empty["events"] == 0 and empty["machine_notes"] == 0


def test_making_events(spark, log, policy):
    targets = spark.createDataFrame([(100, "a", "dir")], "id long, target string, target_type string")
    for made in (claims.annotate(targets, "n", policy), claims.judge(targets, VERDICTS[0], "me", policy), claims.retract(targets, "me", policy)):
        assert made.columns == claims.COLUMNS and claims.validate_claims(made)[1].count() == 0
    note = claims.annotate(targets, "n", policy).first()
    assert (note["verdict"], note["authority"], note["actor_type"], note["source_ref"]) == (None, "L0", "machine", "vault://file/a")
    for verdict, signer in (("maybe", "me"), (VERDICTS[0], " ")):
        with pytest.raises(ValueError):
            claims.judge(targets, verdict, signer, policy)


def test_random_logs_against_a_replay(log):
    rng = random.Random(5)
    rows = [event(i, f"t{rng.randrange(12)}", rng.choice([*VERDICTS, RETRACT]), ts=rng.randrange(20)) for i in range(300)]
    want = {}
    for r in sorted(rows, key=lambda r: (r[-1], r[0])):
        want[r[3]] = r[4]
    assert state(claims.current_claims(log(rows))) == {t: v for t, v in want.items() if v != RETRACT}


# -- snapshots ------------------------------------------------------------------------------------


def test_merge_covers_every_case(make_files, spark):
    prev = make_files({
        "same.md": "a", "changed.md": "old", "vanished.md": "v", "gone-still.md": {"text": "g", "gone": True}, "back-same.md": {"text": "b", "gone": True},
        "back-changed.md": {"text": "c", "gone": True}, "y.md": {"text": "other", "root": "/x"}})
    cur = make_files({"same.md": "a", "changed.md": "newer", "back-same.md": "b", "back-changed.md": "cc", "new.md": "n"}).drop("gone", "scan_id")
    got = {r["rel"]: r for r in snapshot.merge_snapshot(prev, cur, 99, ['/w']).collect()}
    assert {k: (r["action"], r["gone"], r["scan_id"]) for k, r in got.items()} == {
        "same.md": ("reused", False, 99), "changed.md": ("updated", False, 99), "vanished.md": ("removed", True, 99), "gone-still.md": ("gone", True, 1),
        "back-same.md": ("reused", False, 99), "back-changed.md": ("added", False, 99), "new.md": ("added", False, 99), "y.md": ("kept", False, 1)}
    assert got["changed.md"]["body"] == "newer" and got["vanished.md"]["body"] == "v"
    assert {r["path"]: r["action"] for r in snapshot.classify_snapshot(prev, cur, ['/w']).collect()} == {r["path"]: r["action"] for r in got.values()}
    assert {r["rel"] for r in snapshot.vanished(prev, cur, ['/w']).collect()} == {"vanished.md"}
    assert [(r["root"], r["files"]) for r in snapshot.unlisted_roots(prev, ['/w']).collect()] == [("/x", 1)]


def test_unchanged_listing_keeps_extracted_content(make_files):
    prev = make_files({"a.md": "text"})
    listing = prev.drop("gone", "scan_id", "title", "headings", "body", "body_chars", "truncated", "is_binary")
    row = snapshot.merge_snapshot(prev, listing, 5, ['/w']).first()
    assert (row["action"], row["body"], row["scan_id"]) == ("reused", "text", 5)


def test_counters_of_successive_scans(make_files):
    first = {f"{i}.md": "x" for i in range(5)}
    listing = lambda items: make_files(items).drop("gone", "scan_id")
    snap1 = snapshot.merge_snapshot(make_files(first).limit(0), listing(first), 1, ['/w'])
    row = snapshot.scan_run_stats(snap1).first()
    assert (row["files_seen"], row["files_added"], row["files_updated"]) == (5, 5, 0)
    second = {**first, "0.md": "changed", "1.md": "changed", "5.md": "new"}
    snap2 = snapshot.merge_snapshot(snap1.drop("action"), listing(second), 2, ['/w'])
    row = snapshot.scan_run_stats(snap2).first()
    assert (row["files_seen"], row["files_added"], row["files_updated"], row["files_reused"]) == (6, 1, 2, 3)
    row = snapshot.scan_run_stats(snapshot.merge_snapshot(snap2.drop("action"), listing(second), 3, ['/w'])).first()
    assert (row["files_added"], row["files_updated"], row["files_removed"], row["files_reused"]) == (0, 0, 0, 6)


def test_diff_sees_its_own_planted_difference(make_files):
    a = make_files({"a.md": "x", "b.md": "y", "c.md": "z"})
    b = make_files({"a.md": "x", "b.md": "yy", "d.md": "z"})
    got = {(r["path"], r["field"]) for r in snapshot.diff_snapshots(a, b, "path", ["size", "body", "kind"]).collect()}
    assert got == {("/w/b.md", "size"), ("/w/b.md", "body"), ("/w/c.md", "only-in-a"), ("/w/d.md", "only-in-b")}
    assert snapshot.diff_snapshots(a, a, "path", ["size", "body"]).count() == 0


def test_snapshot_write_replaces_only_given_roots(make_files, spark, scratch):
    path = scratch + "/snap"
    sinks.write_snapshot(make_files({"a.md": "x", "b.md": {"text": "y", "root": "/x"}}), path)
    sinks.write_snapshot(make_files({"c.md": "z"}), path)
    assert {r["rel"] for r in spark.read.parquet(path).collect()} == {"c.md", "b.md"}
