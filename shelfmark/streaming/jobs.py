"""Structured Streaming jobs: new files to snapshots, judgments to current state, changes to batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions import keys
from shelfmark.model import CONTENT_COLUMNS, SUBMISSIONS
from shelfmark.operators.claims import COLUMNS as CLAIM_COLUMNS
from shelfmark.operators.claims import newest, not_retracted
from shelfmark.operators.export import build_payloads, read_whole, validate_payloads
from shelfmark.operators.extract import extract_documents
from shelfmark.operators.ledger import new_submissions, plan_submissions, tombstones
from shelfmark.operators.ranking import first_per
from shelfmark.operators.snapshot import apply_allow_list, clean_rel, latest_version, merge_snapshot
from shelfmark.policy import Policy, Root
from shelfmark.sources.corpus import prune_paths, stream_files
from shelfmark.sources.sinks import VersionedTable

# -- judgments ------------------------------------------------------------------------------------


def stream_current(events: DataFrame) -> DataFrame:
    """Newest event per target, kept up continuously; its state is one row per target.

    The newest is the largest (ts, id), so events that arrive late and older change nothing. Retractions stay in
    the stream, since a target that is retracted has to replace what was said about it before.
    """
    rest = [c for c in events.columns if c != "target"]
    return events.groupBy("target").agg(F.max_by(F.struct(*rest), newest()).alias("_row")).select("target", "_row.*")


def current_from_updates(updates: DataFrame) -> DataFrame:
    """The current claims out of the updates the stream has written so far."""
    return first_per(updates, ["target"], newest()).select(*CLAIM_COLUMNS).where(not_retracted())


def start_current(events: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    return (
        stream_current(events).writeStream.outputMode("update")
        .foreachBatch(lambda df, batch: table.write(df, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def with_event_time(claims: DataFrame) -> DataFrame:
    return claims.withColumn("event_time", F.timestamp_seconds("ts"))


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events per day, actor and verdict; a day is final once the watermark has passed it."""
    return (
        events.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day").alias("w"), "actor_type", "verdict")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("day"), "actor_type", "verdict", "events")
    )


def without_repeats(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Suppress events delivered again within the watermark."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"])


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# -- files ----------------------------------------------------------------------------------------


def start_ingest(spark: SparkSession, root: Root, policy: Policy, table: VersionedTable, checkpoint: str,
                 max_files: int = 1000) -> StreamingQuery:
    """New and changed files of a root, extracted and appended: version n holds the rows of micro-batch n.

    A stream only sees files that are there, so what vanished is found by the batch merge of a full listing
    (``merge_snapshot``); ``latest_version`` gives the newest row per path.
    """
    def batch(df: DataFrame, number: int) -> None:
        rows = extract_documents(prune_paths(df, policy), policy)
        table.write(rows.withColumns({
            "gone": F.lit(False), "scan_id": F.lit(number + 1).cast("bigint")}), number)

    return (
        stream_files(spark, root, policy, max_files).writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_versions(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of extracted rows as a version of its own."""
    return (
        stream.writeStream.foreachBatch(lambda df, n: table.write(df, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def refresh_snapshot(prev: DataFrame, ingested: DataFrame, listing: DataFrame, scan_id: int, listed: Sequence[str]) -> DataFrame:
    """The snapshot after a refresh: what the stream extracted, merged by a full listing, so removals are noticed too.

    ``ingested`` appends a row per change; the newest of each path gives the content of rows that changed.
    """
    content = [c for c in CONTENT_COLUMNS if c in ingested.columns]
    newest = latest_version(ingested).select("path", *content)
    return merge_snapshot(prev, listing.drop(*content).join(newest, "path", "left"), scan_id, listed)


# -- export ---------------------------------------------------------------------------------------


def export_batch(changes: DataFrame, number: int, *, manifest: DataFrame, content: DataFrame, ledger: VersionedTable,
                 removals: VersionedTable, errors: VersionedTable, policy: Policy, scope: str,
                 instance: str = "default") -> None:
    """One micro-batch of the change feed: changed documents to ledger rows, removed ones to tombstones.

    Texts are read whole from ``content`` and held against the listed size. A document that cannot be sent as a
    whole becomes a row of ``errors`` with its reason; the others are not held up. Known keys with the same digest are
    left alone, and writing the same micro-batch again replaces its own version, so a repeated batch adds nothing.

    Of manifest, content and ledger only rows that may belong to the micro-batch are shuffled. A text is shuffled once to meet
    its row, and its payloads once to meet what was decided about their keys.
    """
    spark = ledger.spark
    listed = VersionedTable(spark, ledger.path + "_listed")
    fresh = latest_version(changes.drop("body"))
    named = fresh.select(F.xxhash64("root", clean_rel()).alias("key"))
    listed.write(apply_allow_list(fresh, thinned(manifest, F.xxhash64("root", "path"), named)), number)
    rows = listed.read(number)
    there = rows.where(~F.col("gone"))
    read = read_whole(there, thinned(content, F.xxhash64("path"), there.select(F.xxhash64("path").alias("key"))))
    payloads = validate_payloads(build_payloads(read.where("reason IS NULL").drop("reason"), policy, scope, instance), policy)
    # Written once, so that checking the batch and recording it do not build every payload again.
    staging = VersionedTable(spark, ledger.path + "_staging")
    staging.write(payloads.drop("messages", "source_metadata").withColumn("_row", F.monotonically_increasing_id()), number)
    built = staging.read(number)
    # Keys of a batch begin with the id of their document, so the ledger is asked for these documents only.
    known = _before(ledger, number)
    ids = built.select("instance", "stable_id").distinct()
    known = (thinned(known, F.xxhash64("stable_id"), ids.select(F.xxhash64("stable_id").alias("key"))).join(ids, ["instance", "stable_id"], "left_semi")
             if known is not None else spark.createDataFrame([], SUBMISSIONS))
    plan = VersionedTable(spark, ledger.path + "_plan")
    plan.write(plan_submissions(built.select("instance", "source_key", "payload_digest", "stable_id", "rel", "problems", "_row"), known), number)
    staged = plan.read(number)
    faults = F.concat("problems", F.when(F.col("decision") == "conflict", F.array(F.lit("conflict"))).otherwise(F.array().cast("array<string>")))
    refused = staged.select("stable_id", "rel", F.explode(faults).alias("reason")).groupBy("stable_id", "rel").agg(
        F.array_join(F.array_sort(F.collect_set("reason")), "|").alias("reason"))
    taken = staged.where("decision = 'new'").join(refused.select("stable_id"), "stable_id", "left_anti").select("_row", "decision")
    ledger.write(new_submissions(built.join(taken, "_row")), number)
    unread = read.where("reason IS NOT NULL").select(
        keys.stable_id(F.col("root"), F.col("rel")).alias("stable_id"), "rel", "reason", F.lit("read").alias("kind"))
    errors.write(unread.unionByName(refused.withColumn("kind", F.lit("payload"))).withColumn("instance", F.lit(instance)), number)
    existing = _before(removals, number)
    gone = rows.where(F.col("gone"))
    empty = gone.select(*[F.lit("").alias(c) for c in ("instance", "stable_id", "source_key")]).limit(0)
    removals.write(tombstones(gone, existing if existing is not None else empty, instance), number)


def thinned(rows: DataFrame, key: Column, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """``rows`` without most of those whose ``key``, a hash, is not in ``wanted(key)``; none that is there is lost.

    ``wanted`` becomes a bitmap of fixed size, ``1 << bits`` bits in rows of 64, that is broadcast; the join behind it decides.
    """
    slot = lambda c: c.bitwiseAND((1 << bits) - 1)
    words = wanted.select(slot(F.col("key")).alias("_s")).groupBy(F.shiftright("_s", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_bits"))
    marked = rows.withColumns({"_slot": slot(key), "_word": F.shiftright(slot(key), 6)})
    held = marked.join(F.broadcast(words), "_word").where("shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1 = 1")
    return held.select(*rows.columns)


def open_errors(errors: VersionedTable, ledger: VersionedTable) -> DataFrame:
    """Documents whose last attempt failed: an error of a later micro-batch than any of their ledger rows.

    They are what the next run has to offer again; the feed itself goes on past them.
    """
    last = errors.spark.read.parquet(errors.path).groupBy("instance", "stable_id").agg(
        F.max_by(F.struct("rel", "kind", "reason", "version"), "version").alias("_e")).select("instance", "stable_id", "_e.*")
    sent = ledger.spark.read.parquet(ledger.path).groupBy("instance", "stable_id").agg(F.max("version").alias("_sent"))
    return last.join(sent, ["instance", "stable_id"], "left").where("_sent IS NULL OR _sent < version").drop("_sent")


def held_cursor(feed: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: up to which scan everything was sent. An open error holds the cursor in front of its scan."""
    marked = feed.select(keys.stable_id(F.col("root"), F.col("rel")).alias("stable_id"), "scan_id").join(
        failed.select("stable_id", F.lit(True).alias("_failed")), "stable_id", "left")
    first = F.min(F.when(F.col("_failed"), F.col("scan_id") - 1))
    return marked.agg(F.least(F.max("scan_id"), first).alias("cursor"))


def _before(table: VersionedTable, number: int) -> DataFrame | None:
    """What earlier micro-batches wrote; later versions are pruned by their folder."""
    if number == 0:
        return None
    return table.spark.read.parquet(table.path).where(F.col("version") < number).drop("version")


def start_export(feed: DataFrame, checkpoint: str, **settings) -> StreamingQuery:
    """Run the export over a stream of snapshot rows; the checkpoint is the cursor."""
    return (
        feed.writeStream.foreachBatch(lambda df, n: export_batch(df, n, **settings))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
