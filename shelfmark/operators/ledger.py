"""The ledger of sent batches: idempotent submission, results, retries, tombstones."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import keys
from shelfmark.model import SUBMISSIONS
from shelfmark.operators.ranking import side_by_side
from shelfmark.policy import STAGES

COLUMNS = [f.name for f in SUBMISSIONS.fields]
# Length of a stored error, and words by which a refusal counts as one of permission.
ERROR_CHARS = 500
AUTH_WORDS = r"(?i)scope|forbidden|not allowed|unauthor"
RECEIPT_DEPTH = 8
RECEIPT_KEYS = {"source_id": "source", "sourceid": "source", "job_id": "job", "jobid": "job"}
TOOL_AUTH_WORDS = r"(?i)scope|forbidden|not allowed|unauthor|permission"
# End of fixed values.


def plan_submissions(payloads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Offered payloads, one row per key and digest, with a ``decision``: ``new``, ``retry`` (known, not yet
    receipted), ``skip`` or ``conflict``.

    A key offered twice with one digest is one row. The same key with two digests, here or in the ledger, is a
    conflict in all its rows: a receipt must never be overwritten. Repeats are combined before the shuffle.
    """
    key = ["instance", "source_key"]
    rest = [c for c in payloads.columns if c not in (*key, "payload_digest")]
    offered = payloads.groupBy(*key, "payload_digest")
    offered = offered.agg(*[F.first(c).alias(c) for c in rest]) if rest else offered.agg(F.lit(1).alias("_")).drop("_")
    clash = payloads.groupBy(*key).agg(
        (F.min("payload_digest") != F.max("payload_digest")).alias("_clash")).where("_clash")
    known = ledger.select(*key, F.col("payload_digest").alias("_digest"), F.col("stage").alias("_stage"))
    decision = (
        F.when(F.col("_clash") | (F.col("_digest") != F.col("payload_digest")), "conflict")
        .when(F.col("_digest").isNull(), "new")
        .when(F.col("_stage").isin("receipted", "indexed"), "skip")
        .otherwise("retry")
    )
    joined = offered.join(clash, key, "left").join(known, key, "left")
    return joined.withColumn("decision", decision).select(*payloads.columns, "decision")


def new_submissions(planned: DataFrame) -> DataFrame:
    """Ledger rows for payloads that are not known yet."""
    none = F.lit(None).cast("string")
    return planned.where(F.col("decision") == "new").withColumns({
        "stage": F.lit("pending"), "attempts": F.lit(0).cast("bigint"), "source_id": none, "job_id": none,
        "last_error": none, "last_error_kind": none,
    }).select(*COLUMNS)


# -- results --------------------------------------------------------------------------------------


def classify_result() -> Column:
    """Kind of a result row (``status``, ``rpc_error``, ``tool_error``, ``message``); null means accepted.

    A null status is a request whose outcome nobody knows.
    """
    status, text = F.col("status"), F.coalesce("message", F.lit(""))
    return (
        F.when(status.isNull(), "unknown")
        .when(status.isin(401, 403), "auth")
        .when((status == 429) | (status >= 500), "transient")
        .when(status >= 400, "validation")
        .when((status < 200) | (status >= 300), "protocol")
        .when(F.col("rpc_error"), F.when(text.rlike(AUTH_WORDS), "auth").otherwise("validation"))
        .when(F.col("tool_error"), F.when(text.rlike(TOOL_AUTH_WORDS), "auth").otherwise("tool"))
    )


def classify_results(results: DataFrame) -> DataFrame:
    """Add ``kind`` and the ``action`` it calls for: receipt, stop, count (try again unchanged) or fail."""
    action = (
        F.when(F.col("kind").isNull(), "receipt").when(F.col("kind") == "auth", "stop")
        .when(F.col("kind").isin("unknown", "transient"), "count").otherwise("fail")
    )
    return results.withColumn("kind", classify_result()).withColumn("action", action)


@F.pandas_udf(T.StructType([T.StructField("source_id", T.StringType()), T.StructField("job_id", T.StringType())]))
def _receipt_ids(answers: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_ids_in(a) for a in answers], columns=["source_id", "job_id"], dtype=object)


def _ids_in(answer: str | None) -> tuple[str | None, str | None]:
    """The first ids under keys of these names, objects and lists searched in order, as deep as ``RECEIPT_DEPTH``.

    A string counts only as the value of such a key, or if it is itself a JSON object.
    """
    found: dict[str, str] = {}
    todo = [(answer, 0)]
    while todo:
        value, depth = todo.pop()
        if isinstance(value, str):
            try:
                value = json.loads(value) if value.lstrip().startswith("{") else None
            except ValueError:
                continue
        if depth > RECEIPT_DEPTH or not isinstance(value, (dict, list)):
            continue
        inner = []
        for name, item in value.items() if isinstance(value, dict) else enumerate(value):
            kind = RECEIPT_KEYS.get(str(name).lower())
            if kind and isinstance(item, str) and item:
                found.setdefault(kind, item)
            inner.append((item, depth + 1))
        todo += reversed(inner)
    return found.get("source"), found.get("job")


def receipts(results: DataFrame, column: str = "response") -> DataFrame:
    """Add ``source_id`` and ``job_id`` of a JSON answer, also of JSON objects held in its strings.

    Answers are parsed, so ids quoted in free text do not count and escaped values come back plain. How deep an answer
    nests is up to its sender, which column expressions cannot follow; answers come to Python in batches.
    """
    ids = results.withColumn("_ids", _receipt_ids(F.col(column)))
    return ids.withColumns({"source_id": F.col("_ids.source_id"), "job_id": F.col("_ids.job_id")}).drop("_ids")


def apply_results(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger after result events (``instance``, ``source_key``, ``seq``, ``event``, ids and errors).

    Events: submitted, receipted, indexed, failed, counted. Every event but a receipt and an index mark counts as
    an attempt. A batch that was receipted never falls back. All of it is plain partial aggregation, so the number
    of events of one key does not matter.
    """
    event, seq = F.col("event"), F.col("seq")
    last = lambda value, when: F.max_by(value, F.when(when, seq))
    error = event.isin("failed", "counted")
    folded = events.groupBy("instance", "source_key").agg(
        F.count_if(event.isin("submitted", "failed", "counted")).alias("_attempts"),
        F.max(F.when(event == "indexed", 2).when(event == "receipted", 1).otherwise(0)).alias("_done"),
        last(event, event.isin("submitted", "failed")).alias("_last"),
        last(F.col("source_id"), F.col("source_id").isNotNull()).alias("_source_id"),
        last(F.col("job_id"), F.col("job_id").isNotNull()).alias("_job_id"),
        last(F.struct(F.when(error, F.substring("message", 1, ERROR_CHARS)).alias("e"),
                      F.when(error, F.col("kind")).alias("k")), error | (event == "submitted")).alias("_error"),
    )
    done = F.greatest(
        F.coalesce("_done", F.lit(0)),
        F.when(F.col("stage") == "indexed", 2).when(F.col("stage") == "receipted", 1).otherwise(0))
    stage = F.when(done == 2, "indexed").when(done == 1, "receipted").otherwise(F.coalesce("_last", "stage"))
    kept = F.col("_error").isNull()
    return ledger.join(folded, ["instance", "source_key"], "left").withColumns({
        "stage": stage,
        "attempts": F.col("attempts") + F.coalesce("_attempts", F.lit(0)),
        "source_id": F.coalesce("_source_id", "source_id"), "job_id": F.coalesce("_job_id", "job_id"),
        "last_error": F.when(kept, F.col("last_error")).otherwise(F.col("_error.e")),
        "last_error_kind": F.when(kept, F.col("last_error_kind")).otherwise(F.col("_error.k")),
    }).select(*COLUMNS)


def pending(ledger: DataFrame) -> DataFrame:
    """Parts to send again, with the payload exactly as stored."""
    return ledger.where(F.col("stage").isin("pending", "failed", "submitted"))


def exhausted(ledger: DataFrame, max_attempts: int) -> DataFrame:
    """Parts that failed too often and need a person."""
    return ledger.where(F.col("stage").isin("pending", "failed") & (F.col("attempts") >= max_attempts))


def compensation(ledger: DataFrame, max_attempts: int = 5) -> DataFrame:
    """What a retry run sends."""
    return pending(ledger).where(F.col("attempts") < max_attempts).select("instance", "source_key", "payload_json")


def version_complete(ledger: DataFrame) -> DataFrame:
    """Per version: batches, batches with a receipt, and whether all have one."""
    return ledger.groupBy("instance", "stable_id", "version_hash").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("stage").isin("receipted", "indexed")).alias("done"),
    ).withColumn("complete", F.col("total") == F.col("done"))


def export_status(ledger: DataFrame, tombstone_table: DataFrame) -> DataFrame:
    """One row: batches per stage, zeros included, and tombstones waiting."""
    stages = ledger.agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])
    waiting = tombstone_table.agg(F.count_if(F.col("state") == "pending").alias("tombstones_pending"))
    return side_by_side(stages, waiting)


# -- removals -------------------------------------------------------------------------------------


def tombstones(removed: DataFrame, existing: DataFrame, instance: str = "default",
               reason: str = "no longer present") -> DataFrame:
    """Tombstones for removed documents that have none yet."""
    given = F.nullif(F.col("stable_id"), F.lit("")) if "stable_id" in removed.columns else F.lit(None).cast("string")
    fresh = removed.select(
        F.lit(instance).alias("instance"),
        F.coalesce(given, keys.stable_id(F.col("root"), F.col("rel"))).alias("stable_id"),
        F.lit("").alias("source_key"), F.lit(reason).alias("reason"), F.lit("pending").alias("state"),
    ).dropDuplicates(["instance", "stable_id", "source_key"])
    return fresh.join(existing, ["instance", "stable_id", "source_key"], "left_anti")
