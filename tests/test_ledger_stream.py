"""The ledger as a stream: any order, repeats, restarts and timers, against the batch fold of the same events."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.model import SUBMISSIONS
from shelfmark.operators import ledger
from shelfmark.sources.sinks import VersionedTable
from shelfmark.streaming import ledger_stream

KIND = "at timestamp, instance string, source_key string, seq long, event string, source_id string, job_id string, kind string, message string"
HELD = ("source_key", "stage", "attempts", "source_id", "job_id", "last_error", "last_error_kind")


def at(minutes):
    return datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=minutes)


def event(minutes, key, seq, name, source=None, job=None, kind=None, message=None):
    return (at(minutes), "i", key, seq, name, source, job, kind, message)


@pytest.fixture()
def job(spark, scratch):
    """(feed events, run the stream to its end, rows written so far, the ledger it started from)."""
    rows = [tuple({"instance": "i", "source_key": k, "stage": stage, "attempts": n, "part_index": 0, "part_total": 1}.get(
        f.name, None if f.nullable else "") for f in SUBMISSIONS.fields) for k, stage, n in (("a", "pending", 0), ("b", "failed", 3), ("c", "receipted", 1))]
    start = spark.createDataFrame(rows, SUBMISSIONS)
    table = VersionedTable(spark, scratch + "/states")

    def feed(*events):
        spark.createDataFrame(list(events), KIND).coalesce(1).write.mode("append").parquet(scratch + "/feed")

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(scratch + "/feed")
        states = ledger_stream.ledger_states(stream, start, max_attempts=3, wait_ms=600_000, late="1 second")
        ledger_stream.start_ledger(states, table, scratch + "/cp").awaitTermination()
        return spark.read.parquet(table.path)

    return feed, run, start, scratch


def rows(df):
    return sorted(map(tuple, df.select(*HELD).collect()), key=str)


def test_any_order_repeats_and_a_restart_give_the_fold_of_the_events(spark, job):
    feed, run, start, scratch = job
    rng = random.Random(1)
    names = ["submitted", "failed", "counted", "receipted", "indexed"]
    events = [event(0, k, s, rng.choice(names[:3] if k == "a" else names), rng.choice([None, f"s{s}"]), rng.choice([None, f"j{s}"]),
                    rng.choice([None, "tool"]), rng.choice([None, f"m{s}" * 300])) for k in "abc" for s in range(1, 8)]
    shuffled = events + rng.sample(events, 9)
    rng.shuffle(shuffled)
    feed(*shuffled[:10])
    feed(*shuffled[10:17])
    run()
    feed(*shuffled[17:])  # after a restart from the checkpoint
    states = run()
    want = ledger.apply_results(start, spark.createDataFrame(events, KIND))
    assert rows(ledger_stream.current_ledger(start, states)) == rows(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ledger_stream.STORE


def test_timers_ask_again_then_give_up_and_a_receipt_takes_them_back(spark, job):
    feed, run, _, _ = job
    told = lambda states: sorted((r.source_key, r.action, r.attempts) for r in states.where("action <> 'state'").collect())
    feed(event(0, "a", 1, "failed"), event(0, "d", 1, "submitted"), event(0, "b", 9, "failed"))
    assert told(run()) == []
    feed(event(5, "d", 2, "receipted", "s"))
    feed(event(30, "x", 1, "receipted"))  # time passes
    assert told(run()) == [("a", "retry", 1)]
    feed(event(31, "a", 2, "counted"))
    feed(event(100, "x", 2, "indexed"))
    assert told(run()) == [("a", "retry", 1), ("a", "retry", 2), ("b", "exhausted", 4)]
    feed(event(101, "a", 3, "failed"), event(101, "a", 3, "failed"))
    feed(event(300, "x", 3, "indexed"))
    assert told(run()) == [("a", "exhausted", 3), ("a", "retry", 1), ("a", "retry", 2), ("b", "exhausted", 4)]


def test_numbers_far_apart_and_a_wait_put_off(spark, job):
    feed, run, start, _ = job
    told = lambda states: sorted((r.source_key, r.action, r.attempts) for r in states.where("action <> 'state'").collect())
    numbers = [-5, -1, 0, 511, 512, 513, 5000, 2**40]
    events = [event(0, "a", n, "counted", f"s{n}") for n in numbers]
    feed(*events[4:], *events[:2])
    feed(*events)
    feed(event(0, "d", 1, "submitted"))
    feed(event(9, "d", 2, "failed"))
    assert told(run()) == []
    feed(event(20, "x", 1, "indexed"))  # past the first wait of d, not past the second
    states = run()
    assert told(states) == []
    assert {r.source_key: (r.attempts, r.events, r.source_id) for r in states.where("source_key = 'a'").orderBy("events").collect()}["a"] == (8, 8, f"s{2**40}")
    feed(event(40, "x", 2, "indexed"))
    assert told(run()) == [("d", "retry", 2)]


def test_an_event_costs_no_message_of_its_own():
    from types import SimpleNamespace

    from pyspark.sql import Row

    class Counted:
        def __init__(self):
            self.calls, self.held = 0, None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

        def __getattr__(self, name):
            def call(*_):
                self.calls += 1
                return False
            return call

    batches, held = ledger_stream.Batches(5, 1000), Counted()
    batches.handle = batches.state = batches.seen = held
    rows = [Row(at=at(0), seq=n, event="submitted", source_id=None, job_id=None, kind=None, message=None) for n in range(1, 101)]
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    for _ in range(2):
        list(batches.handleInputRows(("i", "a"), iter(rows), times))
    assert held.calls <= 6


def frame(*events):
    """Events as a group gets them: (batch, number, name)."""
    return pd.DataFrame([("i", key, 0, n, name, f"s{n}", None, None, None) for key, n, name in events], columns=ledger_stream.KEY + ledger_stream.EVENT)


def test_batches_of_a_group_share_their_messages():
    from types import SimpleNamespace

    class Counted:
        def __init__(self):
            self.calls, self.held = 0, None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

        def __getattr__(self, name):
            def call(*_):
                self.calls += 1
                return False
            return call

    groups, held = ledger_stream.Groups(5, 1000), Counted()
    groups.handle = groups.state = groups.seen = held
    times = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    events = [(f"k{i}", n, "failed" if i % 2 else "submitted") for i in range(500) for n in (1, 2)]
    start = pd.DataFrame([("i", "k1", "submitted", 7.0, None, "j", None, None), ("i", "k0", "submitted", None, None, None, None, None)],
                         columns=ledger_stream.KEY + ledger_stream.START)
    groups.handleInitialState((0,), start, times)
    for _ in range(2):
        # The second half comes in a frame of its own; a batch is a row all the same.
        made, = groups.handleInputRows((0,), iter([frame(*events[:501]), frame(*events[501:])]), times)
        made = {r.source_key: (r.stage, r.attempts, r.source_id, r.job_id, r.events) for r in made.itertuples()}
        assert len(made) == 500
        assert made["k1"] == ("failed", 9, "s2", "j", 2) and made["k0"] == ("submitted", None, "s2", None, 2)
        assert {v for k, v in made.items() if k not in ("k0", "k1")} == {("failed", 2, "s2", None, 2), ("submitted", 2, "s2", None, 2)}
    assert held.calls <= 10


def test_groups_of_any_size_tell_the_same(spark, scratch):
    rng = random.Random(3)
    names = ["submitted", "failed", "counted", "failed", "receipted"]
    feed = []
    for minutes in (0, 4, 10, 13, 19, 30, 55, 200):
        feed.append([event(minutes + rng.choice([0, 0, 1]), rng.choice("abcdef"), rng.choice([1, 2, 3, 700, 5000]), rng.choice(names)) for _ in range(5)])
    # Waits that end with the watermark, and one that begins there.
    feed += [[event(300, "x", 1, "failed")], [event(301, "y", 1, "failed"), event(301, None, 1, "failed")], [event(311 + 1 / 60, "z", 1, "failed")], [event(330, "z", 2, "indexed")],
             [event(400, "z", 3, "indexed")]]
    for events in feed:
        spark.createDataFrame(events, KIND).coalesce(1).write.mode("append").parquet(scratch + "/feed")
    told = []
    for groups in (1, 1 << 40):
        at = f"{scratch}/{groups}"
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(scratch + "/feed")
        states = ledger_stream.ledger_states(stream, None, max_attempts=3, wait_ms=600_000, late="1 second", groups=groups)
        table = VersionedTable(spark, at + "/states")
        ledger_stream.start_ledger(states, table, at + "/cp").awaitTermination()
        told.append(sorted(map(str, spark.read.parquet(table.path).collect())))
    assert told[0] == told[1]
    assert any("retry" in row and "source_key='y'" in row for row in told[0])
