"""Tables that runs keep: seen postings, histories, caches, usage, schedules, retention and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import coerce, dates
from postmill.functions.text import strip
from postmill.operators.dedup import latest
from postmill.values import LOOKBACK_DAYS, RUNS_PER_DAY

FEEDBACK_TYPES = ("applied", "bookmarked", "not_relevant", "block_company", "wrong_location", "other")
FIELD_LENGTHS = {"job_url": 500, "company": 200, "title": 200, "location": 200, "note": 1000, "date": 32}


def days_ago(now: Column, days: int) -> Column:
    return now - F.expr(f"INTERVAL {int(days)} DAYS")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and the rows of new whose keys it lacks: the earliest stays."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    return latest(old.unionByName(new), keys, order)


def seen_lookback(seen: DataFrame, now: Column) -> DataFrame:
    return seen.where(F.col("evaluated_at") >= days_ago(now, LOOKBACK_DAYS["seen"]))


def prune_history(history: DataFrame, now: Column, days: int = LOOKBACK_DAYS["history"], at: str = "added_at") -> DataFrame:
    """Rows not older than that; without a readable time they go."""
    return history.where(F.col(at).cast("string").try_cast("timestamp") >= days_ago(now, days))


def newest(df: DataFrame, order: list[Column], cap: int, keys: list[str] | None = None) -> DataFrame:
    """The newest cap rows of each key. Without keys Spark keeps each task's best only, then the best of those."""
    if not keys:
        return df.orderBy(*order).limit(cap)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def text_cache(old: DataFrame, new: DataFrame, now: Column, cap: int = 6000) -> DataFrame:
    """Cache of hash, embedding, ts: a known text keeps its first time; expired rows go, then the newest stay."""
    first = old.select("hash", F.col("ts").alias("_first"))
    kept = new.join(first, "hash", "left").withColumn("ts", F.coalesce("_first", "ts")).drop("_first")
    merged = insert_new(kept, old, ["hash"])
    return newest(merged.where(F.col("ts") >= days_ago(now, LOOKBACK_DAYS["text_cache"])), [F.desc("ts"), F.asc("hash")], cap)


def cached(keys: DataFrame, cache: DataFrame, key: str, now: Column, ttl: str) -> DataFrame:
    """keys with the cache's entry where that is not older than ttl."""
    fresh = cache.where(F.col("ts") >= now - F.expr(f"INTERVAL {ttl}"))
    return keys.join(fresh, key, "left")


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose hash the cache lacks: only these go to the embedding call."""
    hashed = texts.select(F.sha2("text", 256).alias("hash"), "text").groupBy("hash").agg(F.first("text").alias("text"))
    return hashed.join(cache.select("hash"), "hash", "left_anti")


# usage


def peak_per_minute(calls: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Most calls of a key in any 60 seconds, both ends included. Calls meet per key and hour, with each hour's
    last minute carried over, so that no key is one task's window."""
    second = F.unix_timestamp(ts) if dict(calls.dtypes)[ts] == "timestamp" else F.unix_timestamp(F.col(ts).cast("timestamp"))
    per = calls.groupBy(*keys, second.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    hour = (F.col("s") / 3600).cast("bigint")
    both = F.when(F.col("s") % 3600 >= 3540, F.array(hour, hour + 1)).otherwise(F.array(hour))
    spread = per.withColumn("h", F.explode(both))
    w = Window.partitionBy(*keys, "h").orderBy("s").rangeBetween(-60, 0)
    return spread.withColumn("calls", F.sum("n").over(w)).groupBy(*keys).agg(F.max("calls").alias("peak_rpm"))


def usage(calls: DataFrame) -> DataFrame:
    """USAGE of calls (user_id, provider, model, ts, ok, tokens) per local day."""
    keys = ["user_id", "provider", "model", "day"]
    daily = calls.withColumn("day", dates.budget_day(F.col("ts")))
    sums = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("requests_failed"), F.sum("tokens").alias("tokens"))
    return sums.join(peak_per_minute(daily, keys), keys)


def add_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["user_id", "provider", "model", "day"]
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("requests", "requests_failed", "tokens")], F.max("peak_rpm").alias("peak_rpm"))


def tokens_of(response: Column) -> Column:
    """Token count of an answer in either of two shapes; 0 without a whole number."""
    x = F.try_parse_json(response)
    return F.coalesce(F.try_variant_get(x, "$.usage.total_tokens", "bigint"), F.try_variant_get(x, "$.usage_metadata.total_token_count", "bigint"), F.lit(0))


def _numbered(calls: DataFrame, keys: list[str], order: list[str], chunk: Column) -> tuple[DataFrame, list[str]]:
    """calls with _c (chunk) and _i, the number from 0 within key and chunk, and the names that make a chunk. A key's
    calls are never one window: chunks are, and their summaries, one row each, carry on from chunk to chunk."""
    own = [*keys, "_c"]
    return calls.withColumn("_c", chunk).withColumn("_i", F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1), own


def rate_limited(calls: DataFrame, keys: list[str], interval: float, at: str = "at", order: str = "ord", chunk_seconds: int = 3600) -> DataFrame:
    """start and wait of each call when a key's calls are at least interval apart: with i calls before it, a call starts
    at i * interval + the largest of (asked - own number * interval) so far. Both are sums and maxima over what came
    before, so chunks of time are numbered by themselves and what their predecessors add is carried over."""
    numbered, own = _numbered(calls, keys, [at, order], F.floor(F.col(at) / chunk_seconds))
    slack = F.col(at) - F.col("_i") * interval
    upto = Window.partitionBy(*keys).orderBy("_c")
    sums = numbered.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.max(slack).alias("_most"))
    sums = sums.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    carried = F.max(F.col("_most") - F.col("_before") * interval).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_carried", carried).select(*own, "_before", "_carried")
    within = F.max(slack).over(Window.partitionBy(*own).orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0))
    joined = numbered.withColumn("_within", within).join(sums, own)
    start = (F.col("_before") + F.col("_i")) * interval + F.greatest(F.col("_within") - F.col("_before") * interval, F.col("_carried"))
    return joined.withColumn("start", start).withColumn("wait", F.col("start") - F.col(at)).drop("_c", "_i", "_within", "_before", "_carried")


def min_interval(rpm: float, safety: float) -> float:
    return 60.0 / rpm * safety


def round_robin(calls: DataFrame, keys: list[str], n: int, order: str = "ord", chunk: int = 10_000) -> DataFrame:
    """account of each call, in turn by the whole number order; chunks of it are numbered by themselves."""
    numbered, own = _numbered(calls, keys, [order], F.floor(F.col(order) / chunk))
    sums = numbered.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_c")) - F.col("_n")
    sums = sums.withColumn("_before", before).select(*own, "_before")
    return numbered.join(sums, own).withColumn("account", F.pmod(F.col("_before") + F.col("_i"), F.lit(n)).cast("int")).drop("_c", "_i", "_before")


# runs


def started(runs: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """runs (id, user_id, status, run_trigger, started_at, ended_at, error and counts), and a running row for each of wanted
    (id, user_id, trigger). An unknown trigger counts as scheduled."""
    known = F.when(F.col("trigger") == "manual", "manual").otherwise("scheduled")
    new = wanted.select("id", "user_id", F.lit("running").alias("status"), known.alias("run_trigger"), now.alias("started_at"))
    return runs.unionByName(new, allowMissingColumns=True)


def finalised(runs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """runs with what outcomes (id, status, counts, error, email_status, email_error) say of them; errors are cut to length."""
    cut = lambda c, n: F.substring(F.nullif(F.col(c), F.lit("")), 1, n)
    told = outcomes.withColumns({"error": cut("error", 2000), "email_error": cut("email_error", 1000), "ended_at": now})
    names = [c for c in told.columns if c != "id"]
    both = runs.join(told.select("id", F.lit(True).alias("_told"), *[F.col(c).alias(f"_new_{c}") for c in names]), "id", "left")
    # without an outcome of the mail its columns stay as they are
    mail = lambda c: F.col("_told") & F.col("_new_email_status").isNotNull() if c.startswith("email_") else F.col("_told")
    for c in names:
        old = F.col(c) if c in runs.columns else F.lit(None).cast(told.schema[c].dataType)
        both = both.withColumn(c, F.when(F.coalesce(mail(c), F.lit(False)), F.col(f"_new_{c}")).otherwise(old))
    return both.drop("_told", *[f"_new_{c}" for c in names])


def claimed(users: DataFrame, now: Column) -> DataFrame:
    """users (frequency_hours, next_run_at, trigger) with the next run that a claim sets before the work starts, so that no
    other tick picks them: a manual run parks it past the day's end, a scheduled one keeps the user's own hours."""
    manual = F.greatest(dates.next_run(now, F.col("frequency_hours")), dates.next_budget_day(now))
    kept = dates.next_anchored(F.coalesce("next_run_at", now), F.col("frequency_hours"), now)
    return users.withColumn("next_run_at", F.when(F.col("trigger") == "manual", manual).otherwise(kept))


def pulled_back(preferences: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """preferences with a near retry for users whose run failed (user_id)."""
    hit = preferences.join(failed.select("user_id", F.lit(True).alias("_failed")).distinct(), "user_id", "left")
    return hit.withColumn("next_run_at", F.when(F.col("_failed"), dates.retry(now)).otherwise(F.col("next_run_at"))).drop("_failed")


def digested(preferences: DataFrame, made: DataFrame, now: Column) -> DataFrame:
    """preferences after a round of digests (user_id, summary): each user's time moves, the text only where there is a new one."""
    told = made.select("user_id", F.nullif(strip(F.coalesce("summary", F.lit(""))), F.lit("")).alias("_summary"), F.lit(True).alias("_made"))
    both = preferences.join(told, "user_id", "left")
    return both.withColumns({"candidate_preferences": F.coalesce("_summary", "candidate_preferences"), "last_digest_at": F.when(F.col("_made"), now).otherwise(F.col("last_digest_at"))}).drop("_summary", "_made")


def approved(evaluated: DataFrame) -> DataFrame:
    """What the model calls valid, of the top and of the lower-ranked postings."""
    return evaluated.where(F.coalesce(F.col("is_valid"), F.lit(False)))


def delivered(embeddings: DataFrame, sent: DataFrame) -> DataFrame:
    """The vectors (user_id, job_url, embedding) of postings that a digest showed: only these enter the history."""
    return embeddings.join(sent.select("user_id", "job_url"), ["user_id", "job_url"], "left_semi")


# schedule


def due_users(preferences: DataFrame, profiles: DataFrame, queries: DataFrame, now: Column, only: str | None = None) -> DataFrame:
    """Active users whose time has come (or the one asked for), on the whitelist and with a text, with their active
    queries; a user without any is left out."""
    ready = F.col("is_active") & ((F.col("user_id") == only) if only is not None else (F.col("next_run_at") <= now))
    active = queries.where("is_active").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("search_term", "location"))).alias("queries"))
    known = profiles.where(F.col("is_whitelisted") & (strip(F.coalesce("cv_text", F.lit(""))) != ""))
    if "github_summary" in profiles.columns:
        known = known.withColumn("github_summary", F.coalesce("github_summary", F.lit("")))
    return preferences.where(ready).join(known, "user_id").join(active, "user_id")


def runs_today(runs: DataFrame, now: Column) -> DataFrame:
    return runs.where(F.col("started_at") >= dates.budget_day_start(now)).groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))


def may_run(users: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """users with used and allowed; a count that cannot be had is as good as used up."""
    counted = users.join(runs_today(runs, now), "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return counted.withColumn("allowed", F.col("is_admin") | (F.col("used") < RUNS_PER_DAY))


def digest_due(users: DataFrame, now: Column, days: int = 5) -> DataFrame:
    return users.where(F.col("last_digest_at").isNull() | (F.col("last_digest_at") < days_ago(now, days)))


# retention


def expired(df: DataFrame, at: str, now: Column, days: int) -> Column:
    return F.col(at) < days_ago(now, days)


def purge(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return df.where(~F.coalesce(expired(df, at, now, days), F.lit(False)))


def purge_results(results: DataFrame, bookmarks: DataFrame, now: Column, days: int = LOOKBACK_DAYS["results_purge"]) -> DataFrame:
    """results without old ones that nobody has marked."""
    old = results.where(expired(results, "created_at", now, days)).select("id")
    gone = old.join(bookmarks.select(F.col("job_result_id").alias("id")).distinct(), "id", "left_anti")
    return results.join(gone, "id", "left_anti")


def old_issues(issues: DataFrame, today: Column, prefix: str, days: int = 5) -> DataFrame:
    return issues.where((F.datediff(today, F.to_date("created_at")) >= days) & F.col("title").startswith(prefix))


# feedback


def sanitised(entries: DataFrame) -> DataFrame:
    """Entries of a known type with an address, their fields cut to length."""
    some = entries.where(F.col("feedback_type").isin(*FEEDBACK_TYPES) & (strip(F.coalesce("job_url", F.lit(""))) != ""))
    return some.select("feedback_type", *[F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n).alias(c) for c, n in FIELD_LENGTHS.items()])


def blocked_companies(blacklist: DataFrame, entries: DataFrame) -> DataFrame:
    """blacklist (pattern), and the companies that entries block, lower-cased and once."""
    more = entries.where("feedback_type = 'block_company'").select(F.lower(strip(F.col("company"))).alias("pattern")).where("pattern <> ''").distinct()
    return insert_new(blacklist, more, ["pattern"])


def drained(inbox: DataFrame, blacklist: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an inbox of entries adds: the clean entries for the log, the addresses applied to for the seen table, and the blacklist with blocked companies."""
    log = sanitised(inbox)
    return log, log.where("feedback_type = 'applied'").select("job_url").distinct(), blocked_companies(blacklist, log)


def needing_vectors(feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    return feedback.join(vectors.select("feedback_id"), "feedback_id", "left_anti")


def missing_suffix(log: DataFrame) -> DataFrame:
    """position, entry of those at the end of a user's log (entries) that have no vector yet (vectors)."""
    return log.select("user_id", F.size("vectors").alias("_have"), F.posexplode("entries").alias("position", "entry")).where("position >= _have").drop("_have")


def feedback_in_order(feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each user's entries that have a vector, with their place in time (ties by id)."""
    both = feedback.join(vectors.select("feedback_id", "embedding"), "feedback_id")
    return both.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("submitted_at", "feedback_id")))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def digest_input(feedback: DataFrame, text: Column, keys: list[str], at: str) -> DataFrame:
    """One text per user, its lines in order of time."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), text.alias("line"))))
    return feedback.groupBy(*keys).agg(lines.alias("lines")).select(*keys, F.size("lines").alias("n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def result_rows(jobs: DataFrame, run_id: str, evaluated: bool) -> DataFrame:
    """Rows of the results table: coerced, and without a verdict where the posting was not evaluated."""
    verdict = F.col("verdict")
    return jobs.select(
        F.lit(run_id).alias("run_id"),
        "user_id",
        *[coerce.optional_text(F.col(c)).alias(c) for c in ("title", "company", "location", "job_url")],
        coerce.origin(F.col("origin")).alias("origin"),
        coerce.similarity(F.col("similarity")).alias("similarity"),
        *[coerce.stored_int(verdict[c]).alias(c) for c in ("tech_fit", "experience_fit", "logistics_fit", "match_percentage")],
        coerce.stored_effort(verdict["effort"]).alias("effort"),
        (verdict["verdict"] if evaluated else F.lit(None).cast("string")).alias("ai_verdict"),
        (verdict["is_valid"] if evaluated else F.lit(None).cast("boolean")).alias("is_valid"),
        F.lit(evaluated).alias("ai_evaluated"),
    )


def run_stats(staged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per run of rows tagged with the stages they reached."""
    return staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("scraped"), *[F.count_if(F.col(c)).alias(c) for c in ("filtered", "ai_evaluated", "approved", "lower_ranked")])


#: Items a sketch level holds: by the sketch's own bound a quantile's rank is off by at most 0.4 % of the rows, with 99 % confidence.
SKETCH_K, SKETCH_ERROR = 800, 0.004


def similarity_summary(jobs: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Least, most and middle similarity of each key. The exact middle holds a key's distinct values in one task; without exact it comes
    from a sketch, of which each task makes one per key, so a hot key costs no more than another."""
    if exact:
        return jobs.groupBy(*keys).agg(F.min("similarity").alias("least"), F.max("similarity").alias("most"), F.median("similarity").alias("middle"))
    return summary_of(similarity_sketches(jobs, keys), keys)


def similarity_sketches(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, least, most and a quantile sketch of similarity: tables of several runs may be kept, put together and merged."""
    known = jobs.where(F.col("similarity").isNotNull()).withColumn("similarity", F.col("similarity").cast("double"))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"), F.max("similarity").alias("most"), F.kll_sketch_agg_double("similarity", F.lit(SKETCH_K)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key from sketches of several runs."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def summary_of(sketches: DataFrame, keys: list[str], rank: float = 0.5) -> DataFrame:
    return sketches.select(*keys, "least", "most", F.kll_sketch_get_quantile_double("sketch", F.lit(rank)).alias("middle"))
