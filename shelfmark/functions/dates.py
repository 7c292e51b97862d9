"""Time expressions. Instants are epoch milliseconds, days and months are UTC."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.policy import DAY_MS, Policy

_RELATIVE = re.compile(
    r"^(\d+(?:\.\d+)?)\s*(h|hours?|小时|d|days?|天|w|weeks?|周|m|months?|月|个月)$", re.IGNORECASE
)


def since_ms(value, policy: Policy) -> int | None:
    """Fold a point in time to a literal: ``7d``, ``24h``, ``2周``, ``3个月``, an ISO date, a number of days or an epoch."""
    if value is None or value == "":
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return policy.cutoff_ms(value) if value < 1e11 else int(value)
    text = str(value).strip()
    if hit := _RELATIVE.match(text):
        unit = hit.group(2).lower()
        if unit.startswith("h") or unit == "小时":
            days = 1 / 24
        elif unit.startswith("d") or unit == "天":
            days = 1
        elif unit.startswith("w") or unit == "周":
            days = 7
        else:
            days = 30
        return policy.cutoff_ms(float(hit.group(1)) * days)
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise ValueError(f"not a date or a period: {value!r}") from e
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp() * 1000)


def as_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def day_text(ms: Column) -> Column:
    return F.when(ms > 0, F.date_format(as_timestamp(ms), "yyyy-MM-dd")).otherwise(F.lit("?"))


def minute_text(ms: Column) -> Column:
    return F.when(ms > 0, F.date_format(as_timestamp(ms), "yyyy-MM-dd HH:mm")).otherwise(F.lit("?"))


def month_key(ms: Column) -> Column:
    return F.date_format(as_timestamp(ms), "yyyy-MM")


def days_ago(ms: Column, policy: Policy) -> Column:
    return F.floor((F.lit(policy.as_of_ms) - ms) / F.lit(DAY_MS)).cast("bigint")


def sane(ms: Column) -> Column:
    return F.year(as_timestamp(ms)).between(2000, 2100)


def age_text(ms: Column, policy: Policy) -> Column:
    """``today``, ``12 days``, ``3 months``, ``2 years``, or ``unknown`` for a stamp no one can trust."""
    days = F.greatest(days_ago(ms, policy), F.lit(0))
    return (
        F.when(~sane(ms), F.lit("unknown"))
        .when(days == 0, F.lit("today"))
        .when(days < 30, F.format_string("%d days", days))
        .when(days < 365, F.format_string("%d months", F.floor(days / 30)))
        .otherwise(F.format_string("%d years", F.floor(days / 365)))
    )
