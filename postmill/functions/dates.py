"""Dates and schedules. Times are UTC; now is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.values import BUDGET_ZONE


def posted(raw: Column) -> Column:
    """Timestamp of Unix seconds, an ISO date or time, or an RFC-822 date; null for anything else."""
    text = raw.cast("string")
    seconds = text.try_cast("double")
    unix = F.when(seconds.between(-1e11, 1e11), F.timestamp_seconds(seconds))
    rfc = F.try_to_timestamp(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(unix, text.try_cast("timestamp"), rfc)


def millis(raw: Column) -> Column:
    n = raw.cast("string").try_cast("bigint")
    return F.when(n.isNotNull(), F.date_format(F.timestamp_millis(n), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).otherwise("")


def linkedin_posted(url: Column) -> Column:
    """Time in the activity id of a post's address: its upper bits are milliseconds."""
    n = F.regexp_extract(url, r"activity-(\d+)", 1).try_cast("bigint")
    return F.timestamp_millis(F.shiftright(n, 22))


def budget_day(ts: Column, zone: str = BUDGET_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def budget_day_start(ts: Column, zone: str = BUDGET_ZONE) -> Column:
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def next_budget_day(ts: Column, zone: str = BUDGET_ZONE) -> Column:
    return budget_day_start(ts, zone) + F.expr("INTERVAL 24 HOURS")


def next_run(now: Column, hours: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now) + F.greatest(F.lit(1), F.coalesce(hours.cast("int"), F.lit(1))) * 3600)


def retry(now: Column) -> Column:
    return now + F.expr("INTERVAL 2 HOURS")


def next_anchored(anchor: Column, hours: Column, now: Column) -> Column:
    """The first time after now that is a whole number of steps after the anchor; a missing anchor is now."""
    step = F.greatest(F.lit(1), F.coalesce(hours.try_cast("int"), F.lit(1))) * 3600
    a, n = F.unix_timestamp(anchor), F.unix_timestamp(now)
    at = F.when(a.isNull(), n + step).when(a + step > n, a + step).otherwise(a + step * (F.floor((n - a) / step) + 1))
    return F.timestamp_seconds(at)
