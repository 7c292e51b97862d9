"""The judgment log: append-only events and the current state they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.model import CLAIMS
from shelfmark.operators.ranking import first_per
from shelfmark.policy import (
    ACTOR_TYPES, AUTHORITIES, CLAIM_KINDS, RETRACT, TARGET_TYPES, VERDICTS, Policy,
)

COLUMNS = [f.name for f in CLAIMS.fields]
REQUIRED = ("kind", "target_type", "target", "source_ref", "holder", "signed_by", "actor_type", "authority")


def reject_reason() -> Column:
    """Why an event may not be appended; null for a good one."""
    out = F.when(F.lit(False), F.lit(""))
    for c in REQUIRED:
        out = out.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"missing:{c}"))
    for c, known in (("kind", CLAIM_KINDS), ("target_type", TARGET_TYPES), ("actor_type", ACTOR_TYPES),
                     ("authority", AUTHORITIES)):
        out = out.when(~F.col(c).isin(*known), F.lit(f"unknown:{c}"))
    judged = F.coalesce(F.col("verdict"), F.lit("")) != ""
    return (
        out.when((F.col("actor_type") == "machine") & (F.col("authority") != "L0"), F.lit("machine-above-L0"))
        .when(judged & (F.col("actor_type") != "human"), F.lit("verdict-needs-human"))
        .when(judged & ~F.col("verdict").isin(*VERDICTS, RETRACT), F.lit("unknown:verdict"))
    )


def check_claims(events: DataFrame) -> DataFrame:
    return events.withColumn("reject_reason", reject_reason())


def validate_claims(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): events that may be appended, and the others with their reason."""
    checked = check_claims(events)
    bad = F.col("reject_reason").isNotNull()
    return checked.where(~bad).drop("reject_reason"), checked.where(bad)


def newest() -> Column:
    """Several events of one second are common, so the id decides between them."""
    return F.struct("ts", "id")


def latest_event(claims: DataFrame) -> DataFrame:
    return first_per(claims, ["target"], newest()).select(*claims.columns)


def not_retracted() -> Column:
    return F.coalesce(F.col("verdict") != RETRACT, F.lit(True))


def current_claims(claims: DataFrame, human_only: bool = False) -> DataFrame:
    """The newest event per target; a retracted target has none.

    Retractions are removed after the newest event is known, otherwise they would uncover an older one.
    """
    rows = claims.where(F.col("actor_type") == "human") if human_only else claims
    return latest_event(rows).where(not_retracted())


def list_claims(claims: DataFrame, *, target: str | None = None, target_type: str | None = None,
                kind: str | None = None, actor_type: str | None = None, signed_by: str | None = None,
                verdict: str | None = None, since_ms: int | None = None, limit: int = 500) -> DataFrame:
    """Matching events, newest first. All filters apply before the limit."""
    rows = _filtered(claims, target, target_type, kind, actor_type, signed_by, verdict, since_ms)
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def list_claims_total(claims: DataFrame, *, target: str | None = None, target_type: str | None = None,
                      kind: str | None = None, actor_type: str | None = None, signed_by: str | None = None,
                      verdict: str | None = None, since_ms: int | None = None, limit: int = 500) -> DataFrame:
    rows = _filtered(claims, target, target_type, kind, actor_type, signed_by, verdict, since_ms)
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("shown", F.least("total", F.lit(limit)))


def _filtered(claims, target, target_type, kind, actor_type, signed_by, verdict, since_ms) -> DataFrame:
    out = claims
    for column, value in (("target", target), ("target_type", target_type), ("kind", kind),
                          ("actor_type", actor_type), ("signed_by", signed_by), ("verdict", verdict)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out if since_ms is None else out.where(F.col("ts") >= since_ms // 1000)


def history(claims: DataFrame, target: str) -> DataFrame:
    return claims.where(F.col("target") == target).orderBy(F.desc("ts"), F.desc("id"))


def claims_summary(claims: DataFrame) -> DataFrame:
    """One row: events, current targets by verdict, machine notes, human claims, targets ever retracted."""
    per_target = claims.groupBy("target").agg(
        F.count(F.lit(1)).alias("_events"),
        F.count_if(F.col("actor_type") == "machine").alias("_machine"),
        F.coalesce(F.max(F.col("verdict") == RETRACT), F.lit(False)).alias("_retracted"),
        F.max_by(F.coalesce("verdict", F.lit("")), newest()).alias("_verdict"),
    )
    current = F.col("_verdict") != RETRACT
    zero = lambda c: F.coalesce(c, F.lit(0))
    return per_target.agg(
        zero(F.sum("_events")).alias("events"),
        F.count_if(current).alias("current_targets"),
        *[F.count_if(F.col("_verdict") == v).alias(f"verdict_{i}") for i, v in enumerate(VERDICTS)],
        F.count_if(F.col("_verdict") == "").alias("unjudged"),
        zero(F.sum("_machine")).alias("machine_notes"),
        (zero(F.sum("_events")) - zero(F.sum("_machine"))).alias("human_claims"),
        F.count_if("_retracted").alias("retracted_targets"),
    )


def newest_machine_notes(claims: DataFrame) -> DataFrame:
    """The newest L0 note of a machine per target."""
    return latest_event(claims.where((F.col("actor_type") == "machine") & (F.col("authority") == "L0")))


def pending_notes(claims: DataFrame) -> DataFrame:
    """Machine notes nobody has answered: the target has no current claim, or a machine's.

    One grouping yields both the newest event and the newest note of a target, so no join is needed.
    """
    row = F.struct(*claims.columns)
    note = (F.col("actor_type") == "machine") & (F.col("authority") == "L0")
    per_target = claims.groupBy("target").agg(
        F.max_by(F.struct("verdict", "actor_type"), newest()).alias("_now"),
        F.max_by(F.when(note, row), F.when(note, newest())).alias("_note"),
    )
    answered = F.coalesce(F.col("_now.verdict") != RETRACT, F.lit(True)) & (F.col("_now.actor_type") != "machine")
    return per_target.where(F.col("_note").isNotNull() & ~answered).select("_note.*").select(*claims.columns)


def judged_progress(dirs: DataFrame, current: DataFrame, key: str = "top_dir") -> DataFrame:
    """How many of the given folders have a verdict."""
    marks = current.where(F.col("verdict").isNotNull()).select(F.col("target").alias(key), F.lit(True).alias("_j"))
    return dirs.select(key).distinct().join(marks, key, "left").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if("_j").alias("judged"),
    ).withColumns({
        "remaining": F.col("targets") - F.col("judged"),
        "fraction": F.when(F.col("targets") > 0, F.col("judged") / F.col("targets")).otherwise(F.lit(0.0)),
    })


# -- making events --------------------------------------------------------------------------------


def _events(targets: DataFrame, policy: Policy, **values: Column) -> DataFrame:
    """Events for (id, target, target_type) rows; the caller hands out the ids."""
    base = {
        "source_ref": F.concat(F.lit("vault://file/"), F.col("target")),
        "ts": F.lit(policy.as_of_ms // 1000).cast("bigint"),
    }
    return targets.withColumns({**base, **values}).select(*COLUMNS)


def annotate(targets: DataFrame, note: str | Column, policy: Policy, kind: str = "material") -> DataFrame:
    """A machine's remark: level L0, no verdict, signed by the policy and not by a person."""
    signer = F.lit(policy.machine_signer)
    return _events(
        targets, policy, kind=F.lit(kind), verdict=F.lit(None).cast("string"),
        note=F.lit(note) if isinstance(note, str) else note, holder=signer, signed_by=signer,
        actor_type=F.lit("machine"), authority=F.lit("L0"))


def judge(targets: DataFrame, verdict: str, signer: str, policy: Policy, note: str = "") -> DataFrame:
    """A person's verdict."""
    if verdict not in (*VERDICTS, RETRACT):
        raise ValueError(f"verdict must be one of {VERDICTS}")
    if not signer.strip():
        raise ValueError("a judgment needs a signer")
    return _events(
        targets, policy, kind=F.lit("judgment"), verdict=F.lit(verdict), note=F.lit(note), holder=F.lit(signer),
        signed_by=F.lit(signer), actor_type=F.lit("human"), authority=F.lit("L1"))


def retract(targets: DataFrame, signer: str, policy: Policy, reason: str = "") -> DataFrame:
    """Taking a verdict back is one more event; nothing is deleted."""
    return judge(targets, RETRACT, signer, policy, reason)

