"""Summaries kept up over several scans equal those computed anew."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import rollup, summaries

COLUMNS = ("root", "rel", "kind", "size", "mtime_ms", "gone", "is_symlink", "denied", "body_chars", "is_text", "is_binary", "ext")


def version(spark, items):
    rows = [(f"{r}/{rel}", r, rel, "." + rel.rsplit(".", 1)[-1], kind, size, ms, gone, False, False, size, True, False) for (r, rel), (kind, size, ms, gone) in items.items()]
    return spark.createDataFrame(rows, "path string, root string, rel string, ext string, kind string, size long, mtime_ms long, gone boolean, is_symlink boolean, "
                                       "denied boolean, body_chars long, is_text boolean, is_binary boolean")


@pytest.mark.parametrize("rung", [False, True])
def test_three_scans(spark, policy, rung):
    rng = random.Random(6)
    keys = summaries.keys_of(policy if rung else None)
    one = lambda: (rng.choice(["doc", "data", None]), rng.choice([0, 5, 70]), rng.randint(1, 6), rng.random() < .15)
    items = {(rng.choice(["/w", "/x"]), f"{rng.choice(['a/', 'b/', ''])}{i}.md"): one() for i in range(60)}
    before = version(spark, items)
    kept = summaries.summarise(before, keys)
    for scan in range(3):
        for key in rng.sample(sorted(items), 9):
            if rng.random() < .4:
                del items[key]
            else:
                items[key] = one()
        items[("/w", f"new/{scan}.md")] = one()
        after = version(spark, items)
        changes = summaries.signed_changes(before, after, COLUMNS)
        assert 0 < changes.count() <= 2 * 11
        kept = spark.createDataFrame(summaries.keep_up(kept, changes, after, keys).collect(), kept.schema)
        assert summaries.drift(kept, after, keys).collect() == []
        before = after
    sets = lambda df: sorted(map(str, df.collect()))
    assert sets(summaries.root_stats(kept)) == sets(rollup.root_stats(after))
    assert sets(summaries.top_level_dirs(kept)) == sets(rollup.top_level_dirs(after))
    assert sets(summaries.kind_distribution(kept)) == sets(rollup.kind_distribution(after))
    if rung:
        assert sets(summaries.coverage_buckets(kept)) == sets(rollup.coverage_buckets(after, policy).select("bucket", "files", "bytes"))


def test_nothing_changed_and_nothing_left(spark):
    keys = summaries.keys_of()
    full = version(spark, {("/w", "a/1.md"): ("doc", 3, 4, False), ("/w", "b.md"): ("doc", 1, 2, True)})
    none = full.where("false")
    kept = summaries.summarise(full, keys)
    again = summaries.keep_up(kept, summaries.signed_changes(full, full, COLUMNS), full, keys)
    assert again.collect() == kept.collect() and kept.count() == 1
    assert summaries.keep_up(kept, summaries.signed_changes(full, none, COLUMNS), none, keys).collect() == []
    assert summaries.keep_up(summaries.summarise(none, keys), summaries.signed_changes(none, full, COLUMNS), full, keys).collect() == kept.collect()
    wrong = kept.withColumn("files", F.col("files") + 1)
    assert summaries.drift(wrong, full, keys).count() == 2
