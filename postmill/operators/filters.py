"""The filter chain over postings: each step is a predicate, and all users' postings pass in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, text, urls
from postmill.functions.dictionary import bound
from postmill.operators import languages
from postmill.operators.careers import containing
from postmill.operators.dedup import first_by_title, first_by_url, users_of
from postmill.values import DEAD_URLS, FEED_ROLE_WORDS, INTERN_BLOCKERS, LOCKED_PLACES, LOOKBACK_DAYS, ROLE_PATTERNS, SENIOR_CODES, SENIOR_WORDS, SIMILARITY_FLOOR, TERSE, anywhere, words

SENIOR = r"\b(?:" + "|".join([*SENIOR_WORDS, *SENIOR_CODES]) + r")\b"
CJK = "[\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]"

def low(column: str = "title") -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def feed_relevant(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike(anywhere(FEED_ROLE_WORDS)), F.lit(False))


def recent(posted: Column, now: Column, hours: int) -> Column:
    """Not older than that; what has no time is kept."""
    return posted.isNull() | (posted >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def filter_feed(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    return jobs.where(feed_relevant(F.col("title")) & recent(dates.posted(F.col("date_posted")), now, hours))


def cjk(title: Column) -> Column:
    return F.coalesce(title.rlike(CJK), F.lit(False))


def english_title(title: Column) -> Column:
    """A title of 30 characters and more in English; shorter ones are too short to tell."""
    told = F.coalesce(title, F.lit(""))
    return (F.length(text.strip(told)) < 30) | (languages.detect(told) == "en")


def english_description(description: Column) -> Column:
    def judged(body: Column) -> Column:
        marked = F.regexp_count(F.substring(body, 1, 500), F.lit("[řůőŘŮŐ]")) >= 3
        return (F.length(body) < TERSE) | (~marked & (languages.detect(body) == "en"))

    return bound(text.squeeze(F.regexp_replace(F.coalesce(description, F.lit("")), "<[^>]+>", " ")), judged)


def senior(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike(SENIOR), F.lit(False))


def wants_senior(level: Column) -> Column:
    return F.lower(F.trim(F.coalesce(level, F.lit("")))).isin("mid", "senior")


def tech_role(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike(anywhere(ROLE_PATTERNS)), F.lit(False))


def blocked_intern(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("none")))
    return t.rlike(r"\bintern\b") & t.rlike(anywhere(INTERN_BLOCKERS))


def location_locked(title: Column, location: Column) -> Column:
    return text.location_locked(title, location, LOCKED_PLACES)


def flag_reputation(jobs: DataFrame, blacklist, trusted, handles=()) -> DataFrame:
    """Flags by patterns in the company's name, and of handles in the address; short lists are literals, so no join is needed."""
    company, address = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("company", "job_url"))
    found = lambda text, patterns: F.exists(F.array(*[F.lit(p.lower()) for p in patterns]), lambda p: F.contains(text, p)) if patterns else F.lit(False)
    return jobs.withColumns({"pre_flagged_low_quality": found(company, blacklist) | found(address, handles), "pre_flagged_trusted": found(company, trusted)})


def flag_by_patterns(jobs: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same flags from a table of any size: patterns (pattern, kind), kind blacklist, trusted (both looked for in the company's
    name) or handle (in the address); null and empty patterns take no part. Each distinct name and address is looked up once."""
    low = patterns.select(F.lower("pattern").alias("_pattern"), "kind")
    named = jobs.withColumns({"_company": F.lower(F.coalesce(F.col("company"), F.lit(""))), "_address": F.lower(F.coalesce(F.col("job_url"), F.lit("")))})

    def hits(column: str, *kinds: str) -> DataFrame:
        own = low.where(F.col("kind").isin(*kinds))
        found = containing(own, "_pattern", named, column).join(own, "_pattern")
        return found.groupBy(column).agg(*[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in kinds])

    told = named.join(hits("_company", "blacklist", "trusted"), "_company", "left").join(hits("_address", "handle"), "_address", "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    return told.withColumns({"pre_flagged_low_quality": is_("_blacklist") | is_("_handle"), "pre_flagged_trusted": is_("_trusted")}).drop("_company", "_address", "_blacklist", "_trusted", "_handle")


def filter_postings(jobs: DataFrame, seen: DataFrame | None = None, local: bool = False, level: str | Column = "entry", blacklist=(), trusted=()) -> DataFrame:
    """The whole chain: seen postings go before duplicates do, so the first unseen copy stays. Local postings skip the
    tests of language, location, seniority and role. Where jobs have a user_id, duplicates, and seen postings that have one
    too, are those of the same user; level may be a column of jobs."""
    if seen is not None:
        keys = [c for c in users_of(jobs) if c in seen.columns] + ["job_url"]
        jobs = jobs.join(seen.select(*keys).distinct(), keys, "left_anti")
    jobs = first_by_title(first_by_url(jobs))
    jobs = flag_reputation(jobs, blacklist, trusted)
    if local:
        return jobs.where(~cjk(F.col("title")))
    title = F.col("title")
    jobs = jobs.where(~cjk(title) & ~location_locked(title, F.col("location")))
    jobs = jobs.where(wants_senior(F.lit(level) if isinstance(level, str) else level) | ~senior(title))
    # languages last: they cost most
    return jobs.where(tech_role(title) & ~blocked_intern(title)).where(english_title(title) & english_description(F.col("description")))


def above_floor(embedded: Column, similarity: Column, origin: Column, floor: float = SIMILARITY_FLOOR) -> Column:
    """Not an embedded posting of other than local origin below the floor."""
    return ~(embedded & (F.coalesce(similarity, F.lit(0.0)) < floor) & (F.coalesce(F.lower(origin), F.lit("")) != "local"))


def stale(source: Column, posted: Column, now: Column, days: int = LOOKBACK_DAYS["stale_ats"]) -> Column:
    return F.coalesce(F.coalesce(source, F.lit("")).startswith("ats_") & (posted < now - F.expr(f"INTERVAL {int(days)} DAYS")), F.lit(False))


def drop_dead(jobs: DataFrame, probes: DataFrame) -> DataFrame:
    """Web-search rows whose probe (job_url, status, final_url) says they are gone are left out; unprobed ones stay."""
    known = probes.select("job_url", urls.alive(F.col("status"), F.col("final_url")).alias("alive"))
    return jobs.join(known, "job_url", "left").where(~F.coalesce(F.col("source"), F.lit("")).startswith("ddg_") | F.coalesce("alive", F.lit(True))).drop("alive")


def dead_address(url: Column) -> Column:
    return url.rlike("(?i)" + anywhere(DEAD_URLS))
