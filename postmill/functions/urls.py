"""Address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip
from postmill.values import DEAD_STATUS, DEAD_URLS, JOB_PATHS, LANDING_PATHS, OTHER_PATHS, OTHER_STARTS

JOB = "(?i)/(?:" + "|".join(JOB_PATHS) + ")/"
OTHER = "(?i)/(?:(?:" + "|".join(OTHER_PATHS) + ")/|(?:" + "|".join(OTHER_STARTS) + "))"
LANDING = "(?i)/(?:" + "|".join(LANDING_PATHS) + ")/?$"
DEAD = "(?i)(?:" + "|".join(DEAD_URLS) + ")"


def job_like(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.when(u.rlike(OTHER), F.contains(F.lower(u), F.lit("linkedin.com/posts/"))).otherwise(u.rlike(JOB))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def specific_job_like(url: Column) -> Column:
    return job_like(url) & ~path(url).rlike(LANDING)


def domain(url: Column) -> Column:
    """Authority of an address without any "www."; an address without scheme has none."""
    return F.replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("www."), F.lit(""))


def linkedin_handle(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)linkedin\.com/(?:company|in|school)/([a-zA-Z0-9_.-]+?)(?:/|$)", 1), F.lit(""))


def linkedin_poster(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"linkedin\.com/posts/([a-z0-9-]+?)(?:_|/)", 1)


def handle_matches(handle: Column, company: Column) -> Column:
    """A word of three letters or more of the company's name is in the handle."""
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce(company, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda t: F.length(t) >= 3)
    return F.exists(tokens, lambda t: F.contains(F.lower(F.coalesce(handle, F.lit(""))), t))


def linkedin_only(website: Column) -> Column:
    return F.contains(domain(website), F.lit("linkedin.com"))


def alive(status: Column, final_url: Column) -> Column:
    """False for a status or final address that says the posting is gone; unknown is alive."""
    return ~F.coalesce(status.isin(*DEAD_STATUS) | F.coalesce(final_url, F.lit("")).rlike(DEAD), F.lit(False))


def names_match(a: Column, b: Column) -> Column:
    """One name contains the other; an empty one is in any."""
    x, y = F.lower(strip(F.coalesce(a, F.lit("")))), F.lower(strip(F.coalesce(b, F.lit(""))))
    return F.contains(x, y) | F.contains(y, x)
