"""Queries over the driver's tables, one or more per operator, each with the same query in DuckDB's SQL where that can say it."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from postmill import values as V
from postmill import views as W
from postmill.functions import coerce, dates, hashing, text, urls, vectors, weights
from postmill.operators import careers, dedup, filters, hooks, languages, preferences, ranking, render, state, verdict, viability
from postmill.operators.tables import Claims, KeyedTable
from postmill.plans.run import tick as run_tick
from postmill.session import removed, shared_dir
from postmill.sources import ats, feeds, files, local
from postmill.streaming import state as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


J, FL, C, U = f"WITH {W.JOBS_SQL} ", f"WITH {W.FLAGGED_SQL} ", f"WITH {W.CALLS_SQL} ", f"WITH {W.USERS_SQL} "
NOW = f"TIMESTAMP '{W.NOW}'"


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


# filters

LOW = "lower(coalesce(title, ''))"
SENIOR, ROLE = matches("lower(title)", filters.SENIOR), matches("lower(title)", V.anywhere(V.ROLE_PATTERNS))
INTERN = f"{matches("lower(coalesce(title, 'none'))", r"\bintern\b")} AND {matches("lower(coalesce(title, 'none'))", V.anywhere(V.INTERN_BLOCKERS))}"
LOCKED = f"{matches("lower(coalesce(location, 'none'))", V.words(V.LOCKED_PLACES, ''))} AND NOT contains(lower(coalesce(location, 'none')), 'remote') AND NOT contains(lower(coalesce(title, 'none')), 'remote')"
CJK = matches("coalesce(title, '')", "[一-鿿぀-ヿ가-힯]")


@query(f"{J} SELECT ord, title FROM jobs WHERE NOT coalesce({SENIOR}, false)")
def seniority_filter(spark, sf_dir):
    return W.jobs(spark, sf_dir).where(~filters.senior(F.col("title"))).select("ord", "title")


@query(f"{J} SELECT ord, title FROM jobs WHERE coalesce({ROLE}, false)")
def role_whitelist(spark, sf_dir):
    return W.jobs(spark, sf_dir).where(filters.tech_role(F.col("title"))).select("ord", "title")


@query(f"{J} SELECT ord, title FROM jobs WHERE NOT ({INTERN})")
def intern_blocker(spark, sf_dir):
    return W.jobs(spark, sf_dir).where(~filters.blocked_intern(F.col("title"))).select("ord", "title")


@query(f"{J} SELECT ord, location FROM jobs WHERE NOT ({LOCKED})")
def location_lock(spark, sf_dir):
    return W.jobs(spark, sf_dir).where(~filters.location_locked(F.col("title"), F.col("location"))).select("ord", "location")


@query(f"{J} SELECT ord, title FROM jobs WHERE NOT {CJK}")
def cjk_title(spark, sf_dir):
    return W.jobs(spark, sf_dir).where(~filters.cjk(F.col("title"))).select("ord", "title")


@query(f"{J} SELECT ord FROM jobs WHERE coalesce({matches('lower(title)', V.anywhere(V.FEED_ROLE_WORDS))}, false) AND posted >= {NOW} - INTERVAL 24 HOURS * 9000")
def feed_recency(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir)
    raw = F.when(F.col("ord") % 2 == 0, F.unix_timestamp(F.col("posted").cast("timestamp")).cast("string")).otherwise(F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss"))
    return filters.filter_feed(jobs.withColumn("date_posted", raw), W.now(), 24 * 9000).select("ord")


SLOTS_SQL = lambda u: f"list_transform(range(1, greatest(len({u}) - 1, 1)), lambda i: ({u}[i] * {languages.FIRST} + {u}[i + 1] * {languages.SECOND} + {u}[i + 2]) % {languages.SLOTS})"
CODES_SQL = lambda t: f"list_transform(string_split({t}, ''), lambda x: unicode(x))"
LETTERS_SQL = lambda c: f"concat(' ', trim(regexp_replace(lower({c}), '[^\\p{{L}}]+', ' ', 'g')), ' ')"
# profiles counted from labelled texts: penalties of all slots, by language and its place
PROFILE_SQL = f"""slotted AS (SELECT lang, place, unnest({SLOTS_SQL('u')}) AS slot FROM (SELECT lang, place, {CODES_SQL('t')} AS u FROM labelled)),
profile AS (
  SELECT g.lang, g.place, list(least({languages.WORST}, CAST(round(-{languages.SCALE} * ln((coalesce(n, 0) + {languages.SMOOTH}) / (total + {languages.SMOOTH} * {languages.SLOTS}))) AS INT)) ORDER BY g.slot) AS penalties
  FROM (SELECT lang, place, unnest(range({languages.SLOTS})) AS slot, total FROM (SELECT lang, place, count(*) AS total FROM slotted GROUP BY 1, 2)) g
  LEFT JOIN (SELECT lang, slot, count(*) AS n FROM slotted GROUP BY 1, 2) c ON c.lang = g.lang AND c.slot = g.slot GROUP BY 1, 2
)"""
OWN_SQL = f"labelled AS (SELECT lang, place, {LETTERS_SQL('t')} AS t FROM (VALUES {', '.join(f'({quoted(k)}, {i}, {quoted(t)})' for i, (k, t) in enumerate(languages.TEXTS.items()))}) x(lang, place, t)), {PROFILE_SQL}"


def _language_sql(column: str) -> str:
    """Needs a table called profile."""
    some, k = f"substr({column}, 1, {languages.SAMPLE})", languages.STRETCH
    three = f"concat_ws(' ', substr({some}, 1, {k}), substr({some}, CAST(floor((length({some}) - {k}) / 2) AS INT) + 1, {k}), substr({some}, length({some}) - {k} + 1, {k}))"
    text = LETTERS_SQL(f"CASE WHEN length({some}) > {3 * k} THEN {three} ELSE {some} END")
    return f"(SELECT arg_min(lang, coalesce(list_sum(list_transform(slots, lambda s: penalties[s + 1])), 0) * 100 + place) FROM profile, (SELECT {SLOTS_SQL('u')} AS slots FROM (SELECT {CODES_SQL(text)} AS u)))"


def _english_sql(body: str) -> str:
    """body: as BODY gives it."""
    return f"(length({body}) < {V.TERSE} OR (len(regexp_extract_all(substr({body}, 1, 500), '[řůőŘŮŐ]')) < 3 AND {_language_sql(body)} = 'en'))"


BODY = lambda c: strip_sql(f"regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")


@query(f"WITH {OWN_SQL} SELECT doc_id, {_english_sql('body')} AS english, {_language_sql("coalesce(text, '')")} AS guess FROM (SELECT *, {BODY('text')} AS body FROM documents)")
def description_language(spark, sf_dir):
    docs = W.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select("doc_id", filters.english_description(F.col("text")).alias("english"), languages.detect(F.coalesce("text", F.lit(""))).alias("guess"))


# the rows whose language is known to the profiles
LEARNT = "(doc_id % 5 <> 0 AND lang IS NOT NULL AND text IS NOT NULL)"


@query(
    f"WITH labelled AS (SELECT lang, dense_rank() OVER (ORDER BY lang) AS place, {LETTERS_SQL('text')} AS t FROM documents WHERE {LEARNT}), {PROFILE_SQL} "
    f"SELECT doc_id, lang, {_language_sql('text')} AS guess FROM documents WHERE NOT {LEARNT} AND text IS NOT NULL"
)
def learnt_language(spark, sf_dir):
    """Profiles counted from four fifths of the documents' own languages, applied to the others."""
    docs = W.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    known = languages.model(languages.profiles(docs.where(LEARNT)))
    return docs.where(f"NOT {LEARNT} AND text IS NOT NULL").select("doc_id", "lang", languages.detect(F.col("text"), known).alias("guess"))


FIRST_URL = "SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY user_id, job_url ORDER BY ord) = 1"
BARE = lambda c: f"lower({strip_sql(f"regexp_replace(coalesce({c}, 'none'), '\\s*\\(.*?\\)', '', 'g')")})"
FIRST_TITLE = f"SELECT * FROM first_url QUALIFY row_number() OVER (PARTITION BY user_id, {BARE('title')}, {BARE('company')} ORDER BY ord) = 1"


@query(f"{J} SELECT ord, job_url FROM ({FIRST_URL})")
def url_dedup_keep_first(spark, sf_dir):
    return dedup.first_by_url(W.jobs(spark, sf_dir)).select("ord", "job_url")


@query(f"{J}, first_url AS ({FIRST_URL}) SELECT ord, title, company FROM ({FIRST_TITLE})")
def title_company_dedup(spark, sf_dir):
    return dedup.first_by_title(dedup.first_by_url(W.jobs(spark, sf_dir))).select("ord", "title", "company")


@query(f"{FL} SELECT ord, coalesce(low, false) AS pre_flagged_low_quality, coalesce(good, false) AS pre_flagged_trusted FROM flagged")
def reputation_flags(spark, sf_dir):
    return W.flagged(spark, sf_dir).select("ord", "pre_flagged_low_quality", "pre_flagged_trusted")


SEEN_SQL = "seen AS (SELECT DISTINCT concat('u', CAST(user_id % 40 AS STRING)) AS user_id, concat('https://jobs.example.com/jobs/', CAST(event_id % 4000 AS STRING)) AS job_url FROM events)"


def seen(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("user_id"), F.concat(F.lit("https://jobs.example.com/jobs/"), (F.col("event_id") % 4000).cast("string")).alias("job_url"), F.col("ts").cast("timestamp").alias("evaluated_at"))


@query(f"WITH {W.JOBS_SQL}, {SEEN_SQL} SELECT j.ord FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = j.user_id AND s.job_url = j.job_url)")
def seen_anti_join(spark, sf_dir):
    return dedup.unseen(W.jobs(spark, sf_dir), seen(spark, sf_dir)).select("ord")


@query(f"WITH {W.JOBS_SQL}, {SEEN_SQL} SELECT user_id, job_url, count(*) AS n FROM (SELECT user_id, job_url FROM seen UNION SELECT user_id, job_url FROM jobs) GROUP BY 1, 2")
def seen_upsert_donothing(spark, sf_dir):
    old = seen(spark, sf_dir).groupBy("user_id", "job_url").agg(F.min("evaluated_at").alias("evaluated_at"))
    new = W.jobs(spark, sf_dir).select("user_id", "job_url", W.now().alias("evaluated_at")).dropDuplicates(["user_id", "job_url"])
    return state.insert_new(old, new, ["user_id", "job_url"]).groupBy("user_id", "job_url").agg(F.count(F.lit(1)).alias("n"))


FIRST_FLAGGED = f"first_url AS ({FIRST_URL.replace('FROM jobs', 'FROM flagged')}), kept AS (SELECT *, {BODY('description')} AS body FROM ({FIRST_TITLE}))"
CHAIN = f"NOT {CJK} AND (length({strip_sql("coalesce(title, '')")}) < 30 OR {_language_sql('title')} = 'en') AND {_english_sql('body')} AND NOT ({LOCKED}) AND coalesce({ROLE}, false) AND NOT ({INTERN})"


@query(f"WITH {OWN_SQL}, {W.FLAGGED_SQL}, {FIRST_FLAGGED} SELECT ord, title FROM kept WHERE {CHAIN} AND NOT coalesce({SENIOR}, false)")
def filter_chain(spark, sf_dir):
    return filters.filter_postings(W.jobs(spark, sf_dir)).select("ord", "title")


@query(f"WITH {W.FLAGGED_SQL}, {FIRST_FLAGGED} SELECT ord, title FROM kept WHERE NOT {CJK}")
def filter_chain_local(spark, sf_dir):
    return filters.filter_postings(W.jobs(spark, sf_dir), local=True).select("ord", "title")


@query(f"WITH {OWN_SQL}, {W.JOBS_SQL} SELECT ord, length({strip_sql('title')}) < 30 OR {_language_sql('title')} = 'en' AS english FROM (SELECT ord, concat(coalesce(title, ''), ' ', description) AS title FROM jobs)")
def title_language(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", filters.english_title(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "description")).alias("english"))


# viability


def _other_sql(at: str, length: str) -> str:
    first = f"greatest({at} - 14, 1)"
    return matches(f"substr(d, CAST({first} AS BIGINT), CAST({at} + {length} + 12 - {first} AS BIGINT))", viability.OTHER_YEARS)


def _requirement_sql() -> str:
    out = []
    grab = lambda p: f"regexp_extract(d, {quoted(p)})"
    for p in (viability.YEARS_RANGE, *viability.REQUIRED_YEARS):
        m = grab(p)
        high = f"AND CAST(regexp_extract(d, {quoted(p)}, 1) AS INTEGER) >= 5 " if p == viability.YEARS_RANGE else ""
        out.append(f"CASE WHEN {m} <> '' {high}AND NOT {_other_sql(f'strpos(d, {m})', f'length({m})')} THEN {m} END")
    out += [f"nullif({grab(p)}, '')" for p in viability.SENIOR_TITLES]
    return "coalesce(" + ", ".join(out) + ")"


GEO_LOCK = viability.GEO_LOCK.replace("(?U)", "")
PLACE = viability.PLACE_LOCK.replace("(?iU)", "(?i)"), viability.PLACE_REMOTE.replace("(?iU)", "(?i)")
REASON = (
    "CASE WHEN coalesce(low, false) THEN 'blacklisted by reputation list' "
    + " ".join(f"WHEN contains(t, '{s}') THEN 'non-tech role signal in title ({s.strip()})'" for s in V.NON_TECH_SIGNALS)
    + " WHEN NOT (b IN ('', 'nan', 'none', 'null') OR length(b) < 20 OR starts_with(s, 'ddg_') OR s IN ('telegram', 'jobs_ps') OR o = 'local' OR starts_with(t, 'linkedin post:') OR contains(d, '[no description') OR contains(d, '[description truncated')) AND length(b) < 150 THEN concat('description too short (', length(b), ' chars)')"
    + " WHEN need IS NOT NULL THEN concat('senior experience requirement in description (', need, ')') "
    + " ".join(f"WHEN {matches('d', p)} THEN {quoted('hard disqualifier: ' + r)}" for p, r in viability.DISQUALIFIERS)
    + f" WHEN {matches('d', GEO_LOCK)} THEN concat('hard disqualifier: geo-locked (', trim(substr(regexp_extract(d, {quoted(GEO_LOCK)}), 1, 60)), ')')"
    + f" WHEN {matches('place', PLACE[0])} OR {matches('place', PLACE[1])} THEN concat('location geo-locked (', substr(place, 1, 60), ')') END"
)


@query(f"""{FL}, parts AS (SELECT ord, low, lower(coalesce(title, '')) AS t, lower(coalesce(description, '')) AS d, trim(lower(coalesce(description, ''))) AS b, lower(coalesce(source, '')) AS s, lower(coalesce(origin, '')) AS o, trim(coalesce(location, '')) AS place FROM flagged),
needs AS (SELECT *, trim({_requirement_sql()}) AS need FROM parts) SELECT ord, {REASON} AS skip_reason FROM needs""")
def viability_reason(spark, sf_dir):
    return viability.gate(W.flagged(spark, sf_dir)).select("ord", "skip_reason")


@query(f"WITH d AS (SELECT ord, lower(coalesce(description, '')) AS d FROM ({W.select_sql(W.JOB, 'orders')})) SELECT ord, {_requirement_sql()} AS phrase FROM d")
def senior_requirement(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", viability.senior_requirement(F.lower(F.coalesce("description", F.lit("")))).alias("phrase"))


@query(f"WITH d AS (SELECT ord, lower(coalesce(description, '')) AS d FROM ({W.select_sql(W.JOB, 'orders')})) SELECT ord, {W.any_of('d', V.WEB_TRIGGERS)} OR ({W.any_of('d', V.WEB_AMBIGUOUS)} AND NOT {W.any_of('d', V.WEB_GLOBAL)}) AS wanted FROM d")
def web_search_trigger(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", viability.wants_web_search(F.col("description")).alias("wanted"))


# weights and ranking

REGION_TEXT = "concat(coalesce(location, ''), ' ', coalesce(title, ''), ' ', coalesce(company, ''), ' ', substr(coalesce(description, ''), 1, 1200))"
_names = lambda n: V.words(V.REGION_NAMES[n], "(?i)").replace(r"(?<!new\s+)", "").replace(r"(?<!new\s)", "")
REGION = "CASE " + " ".join(f"WHEN {matches(REGION_TEXT, _names(n))} THEN '{n}'" for n in ("heavily_deweighted", "highly_preferred", "preferred", "deweighted")) + " ELSE 'neutral' END"
REGION_WEIGHT = f"CASE {REGION} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in V.REGION_WEIGHTS.items()) + " END"
TIER = f"CASE WHEN trim(coalesce(title, '')) = '' THEN 'other' WHEN {matches('title', V.words(V.AI_ROLES, '(?i)'))} THEN 'ai' WHEN {matches('title', V.words(V.SOFTWARE_ROLES, '(?i)'))} THEN 'swe' ELSE 'other' END"
ROLE_WEIGHT = f"CASE {TIER} WHEN 'ai' THEN 1.2 WHEN 'swe' THEN 1.1 ELSE 1.0 END"
TRUST = "CASE WHEN coalesce(good, false) THEN 1.25 ELSE 1.0 END"
COMBINED = f"CAST({REGION_WEIGHT} AS DOUBLE) * CAST({TRUST} AS DOUBLE) * CAST({ROLE_WEIGHT} AS DOUBLE)"


@query(f"{J} SELECT ord, {REGION} AS region, CAST({REGION_WEIGHT} AS DOUBLE) AS weight FROM jobs")
def region_weight(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", weights.region().alias("region"), weights.region_weight().alias("weight"))


@query(f"{J} SELECT ord, {TIER} AS tier, CAST({ROLE_WEIGHT} AS DOUBLE) AS weight FROM jobs")
def role_weight(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", weights.role_tier(F.col("title")).alias("tier"), weights.role_weight(F.col("title")).alias("weight"))


CHOSEN = ("backend", "mobile", "data_engineering", "unheard_of")


@query(f"{J} SELECT ord, CAST(CASE WHEN {' OR '.join(matches("coalesce(title, '')", V.words(V.PATHS[p], '(?i)')) for p in CHOSEN[:3])} THEN 1.2 ELSE 1.0 END AS DOUBLE) AS weight FROM jobs")
def path_weight(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", weights.role_weight(F.col("title"), F.array(*map(F.lit, CHOSEN))).alias("weight"))


@query(f"{FL} SELECT ord, round({COMBINED}, 6) AS weight FROM flagged")
def combined_weight(spark, sf_dir):
    return W.flagged(spark, sf_dir).select("ord", F.round(weights.combined_weight(F.col("title"), F.col("pre_flagged_trusted")), 6).alias("weight"))


PATH_KEYS, LABELS = list(V.PATH_LABELS), ", ".join(quoted(v) for v in V.PATH_LABELS.values())
KEYS = ", ".join(map(quoted, PATH_KEYS))


@query(f"""SELECT c_custkey, concat([{LABELS}][c_custkey % 13 + 1], ', ', [{LABELS}][c_custkey * 5 % 13 + 1], ', Odd Path') AS labels,
CASE WHEN c_custkey % 13 = c_custkey * 5 % 13 THEN [{KEYS}][c_custkey % 13 + 1] ELSE concat([{KEYS}][c_custkey % 13 + 1], ',', [{KEYS}][c_custkey * 5 % 13 + 1]) END AS known FROM customer""")
def path_labels(spark, sf_dir):
    customer, own = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.array(*map(F.lit, PATH_KEYS))
    key = lambda n: F.get(own, (F.col("c_custkey") * n % len(PATH_KEYS)).cast("int"))
    paths = F.array(key(1), key(5), F.lit("odd_path"))
    return customer.select("c_custkey", weights.path_labels(paths).alias("labels"), F.array_join(weights.known_paths(F.array(key(1), F.lit("nothing"), key(1), key(5))), ",").alias("known"))


VECTOR_SQL = "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS e, count(*) OVER () AS n FROM embeddings), cv AS (SELECT e AS c FROM vectors WHERE vec_id = 0)"


def scored(spark, sf_dir, jobs=None):
    e = embeddings(spark, sf_dir)
    n = e.count()
    own = (W.flagged(spark, sf_dir) if jobs is None else jobs).drop("similarity").withColumn("vec_id", F.when(F.col("ord") % 17 > 0, F.col("ord") % n))
    profile = e.where("vec_id = 0").first()["embedding"]
    cv = F.array(*[F.lit(float(x)) for x in profile])
    with_vector = own.join(e.select("vec_id", "embedding"), "vec_id", "left")
    return with_vector.withColumn("similarity", vectors.cosine(F.col("embedding"), cv)).withColumn("weighted_score", F.col("similarity") * weights.combined_weight(F.col("title"), F.col("pre_flagged_trusted")))


SCORED_SQL = f"{W.FLAGGED_SQL}, {VECTOR_SQL}, scored AS (SELECT f.* EXCLUDE (similarity), v.e, CASE WHEN v.e IS NULL THEN 0.0 ELSE list_cosine_similarity(v.e, (SELECT c FROM cv)) END AS similarity, CASE WHEN v.e IS NULL THEN 0.0 ELSE list_cosine_similarity(v.e, (SELECT c FROM cv)) END * {COMBINED} AS weighted_score FROM flagged f LEFT JOIN vectors v ON v.vec_id = CASE WHEN f.ord % 17 > 0 THEN f.ord % (SELECT max(n) FROM vectors) END)"


@query(f"""WITH {SCORED_SQL}, first_url AS ({FIRST_URL.replace('FROM jobs', 'FROM scored')}), kept AS ({FIRST_TITLE})
SELECT user_id, CAST(rank AS INT) AS rank, ord, round(weighted_score, 6) AS weighted_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weighted_score, 9) DESC, ord) AS rank FROM kept WHERE NOT ({LOCKED}) AND NOT coalesce({SENIOR}, false) AND coalesce({ROLE}, false) AND NOT ({INTERN})) WHERE rank <= 10""")
def flagship_rank_topn(spark, sf_dir):
    # duplicates and what the filters drop go first: only survivors meet their vectors and the region patterns
    slim = W.flagged(spark, sf_dir).select("ord", "user_id", "title", "company", "location", "description", "job_url", "pre_flagged_trusted")
    jobs = dedup.first_by_title(dedup.first_by_url(slim))
    title = F.col("title")
    kept = jobs.where(~filters.location_locked(title, F.col("location")) & ~filters.senior(title) & filters.tech_role(title) & ~filters.blocked_intern(title))
    best = scored(spark, sf_dir, kept)
    return dedup.ranked(best, ["user_id"], [F.round("weighted_score", 9).desc(), F.asc("ord")], 10).select("user_id", "rank", "ord", F.round("weighted_score", 6).alias("weighted_score"))


@query(f"WITH {SCORED_SQL} SELECT ord FROM scored WHERE NOT (e IS NOT NULL AND similarity < 0.1 AND coalesce(lower(origin), '') <> 'local')")
def similarity_floor(spark, sf_dir):
    return scored(spark, sf_dir).where(filters.above_floor(F.col("embedding").isNotNull(), F.col("similarity"), F.col("origin"), 0.1)).select("ord")


SPLIT_SQL = """placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(similarity, 0) DESC, ord) AS place FROM jobs), drawn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (place <= 55)::INT, sha256(concat('42:', coalesce(job_url, ''))), ord) AS draw FROM placed),
named AS (SELECT *, CASE WHEN place <= 55 THEN 'top' WHEN draw <= 5 THEN 'wildcard' ELSE 'lower' END AS part FROM drawn), ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY coalesce(similarity, 0) DESC, ord) AS rank FROM named)"""


@query(f"WITH {W.JOBS_SQL}, {SPLIT_SQL} SELECT user_id, part, CAST(rank AS INT) AS rank, ord FROM ranked WHERE part <> 'lower' OR rank <= 25")
def topn_wildcard_split(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir).withColumn("weighted_score", F.coalesce(F.col("similarity").cast("double"), F.lit(0.0)))
    return ranking.top_and_wildcards(jobs, ["user_id"]).select("user_id", "part", "rank", "ord")


NUMBER = "TRY_CAST(regexp_replace(match_text, '%$', '') AS DOUBLE)"


@query(f"{FL} SELECT user_id, CAST(rank AS INT) AS rank, ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce({NUMBER}, -1) DESC, coalesce(similarity, 0) DESC, ord) AS rank FROM flagged WHERE NOT coalesce(low, false) AND NOT suspicious AND NOT scam) WHERE rank <= 15")
def lower_ranked_shown(spark, sf_dir):
    jobs = W.flagged(spark, sf_dir).withColumns({"match_percentage": F.col("match_text"), "weighted_score": F.lit(None).cast("double"), "similarity": F.col("similarity").cast("double")})
    return ranking.lower_ranked_shown(jobs, ["user_id"]).select("user_id", "rank", "ord")


@query(f"{J} SELECT ord, CAST(row_number() OVER (ORDER BY coalesce({NUMBER}, -1) DESC, tech_fit DESC, ord) AS INT) AS place FROM jobs ORDER BY place LIMIT 100")
def match_sort_top(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir).withColumn("match_percentage", F.col("match_text"))
    best = ranking.sort_by_match(jobs).limit(100)
    match = F.coalesce(coerce.match_number(F.col("match_percentage")), F.lit(-1.0))
    return dedup.ranked(best, [], [match.desc(), F.desc("tech_fit"), F.asc("ord")], 100, "place").select("ord", "place")


@query(f"{J} SELECT ord FROM jobs WHERE {NUMBER} IS NULL OR {NUMBER} < 0 OR {NUMBER} >= 55")
def display_floor(spark, sf_dir):
    return W.jobs(spark, sf_dir).where(ranking.shown(F.col("match_text"))).select("ord")


@query(f"{J} SELECT ord FROM jobs WHERE ord % 60 <= 0 OR coalesce({NUMBER}, 0) >= ord % 60")
def minimum_match(spark, sf_dir):
    return W.jobs(spark, sf_dir).where(ranking.meets_minimum(F.col("match_text"), F.col("ord") % 60)).select("ord")


@query(f"{J} SELECT user_id, count(*) FILTER (WHERE intern) AS internships, count(*) FILTER (WHERE NOT intern) AS others FROM (SELECT user_id, contains({LOW}, 'intern') OR job_type = 'internship' AS intern FROM jobs WHERE {NUMBER} IS NULL OR {NUMBER} < 0 OR {NUMBER} >= 55) GROUP BY user_id")
def internship_split(spark, sf_dir):
    shown = W.jobs(spark, sf_dir).where(ranking.shown(F.col("match_text"))).select("user_id", ranking.is_internship(F.col("title"), F.col("job_type")).alias("i"))
    return shown.groupBy("user_id").agg(F.count_if("i").alias("internships"), F.count_if(~F.col("i")).alias("others"))


PAIR = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _postings(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    scaled = e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x: x * 2).alias("embedding"))
    both = e.select("vec_id", "embedding").unionByName(scaled.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")))
    return both.select(F.col("vec_id").cast("string").alias("job_url"), F.when(F.col("vec_id") % 37 > 0, F.col("embedding")).alias("embedding"))


POSTINGS = "posts AS (SELECT CAST(vec_id AS STRING) AS job_url, CASE WHEN vec_id % 37 > 0 THEN e END AS embedding FROM (SELECT vec_id, embedding AS e FROM embeddings UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x: x * 2) FROM embeddings))"


def _semantic_sql(threshold: float) -> str:
    return f"WITH {POSTINGS}, past AS (SELECT CAST(vec_id AS STRING) AS job_url, embedding FROM embeddings) SELECT a.job_url FROM posts a WHERE NOT EXISTS (SELECT 1 FROM past b WHERE a.embedding IS NOT NULL AND a.job_url <> b.job_url AND {PAIR} >= {threshold})"


def _semantic(spark, sf_dir, threshold):
    past = embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("job_url"), "embedding")
    return dedup.drop_similar(_postings(spark, sf_dir), past, threshold).select("job_url")


@query(_semantic_sql(0.97))
def semantic_dedup(spark, sf_dir):
    return _semantic(spark, sf_dir, 0.97)


@query(_semantic_sql(0.45))
def semantic_dedup_low_threshold(spark, sf_dir):
    return _semantic(spark, sf_dir, 0.45)


@query(_semantic_sql(0.97))
def semantic_dedup_lsh(spark, sf_dir):
    past = embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("job_url"), "embedding")
    return dedup.drop_similar_lsh(_postings(spark, sf_dir), past).select("job_url")


@query("""WITH q AS (SELECT label, vec_id AS ord, embedding FROM embeddings), f AS (SELECT label, vec_id AS entry, embedding FROM embeddings)
SELECT * FROM (SELECT a.label, a.ord, CAST(row_number() OVER (PARTITION BY a.label, a.ord ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.entry) AS INT) AS rank, b.entry FROM q a JOIN f b USING (label)) WHERE rank <= 5""")
def feedback_topk(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    jobs = e.select("label", F.col("vec_id").alias("ord"), "embedding")
    log = e.select("label", F.col("vec_id").alias("entry"), "embedding")
    return ranking.relevant_feedback(jobs, log, ["label"]).select("label", "ord", "rank", "entry")


@query("SELECT vec_id, round(list_cosine_similarity(embedding[1:10]::DOUBLE[], embedding[2:11]::DOUBLE[]), 6) AS shifted, 0.0::DOUBLE AS zero, 0.0::DOUBLE AS nothing FROM embeddings")
def cosine_cases(spark, sf_dir):
    e = F.col("embedding")
    zero = F.array_repeat(F.lit(0.0), 64)
    return embeddings(spark, sf_dir).select("vec_id", F.round(vectors.cosine(F.slice(e, 1, 10), F.slice(e, 2, 10)), 6).alias("shifted"), vectors.cosine(e, zero).alias("zero"), vectors.cosine(e, F.lit(None).cast("array<double>")).alias("nothing"))


@query("SELECT vec_id, 64::INT AS n FROM embeddings")
def vector_codec(spark, sf_dir):
    back = vectors.from_literal(vectors.to_literal(F.col("embedding").cast("array<double>")))
    return embeddings(spark, sf_dir).where(back == F.col("embedding").cast("array<double>")).select("vec_id", F.size(back).alias("n"))


# usage, schedules, retention


@query(f"""{C}, daily AS (SELECT *, CAST(timezone('Asia/Jerusalem', timezone('UTC', ts)) AS DATE) AS day FROM calls),
peaks AS (SELECT user_id, provider, model, day, max(n) AS peak_rpm FROM (SELECT *, count(*) OVER (PARTITION BY user_id, provider, model, day ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM daily) GROUP BY 1, 2, 3, 4)
SELECT user_id, provider, model, CAST(day AS STRING) AS day, count(*) AS requests, count(*) FILTER (WHERE NOT ok) AS requests_failed, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(max(peak_rpm) AS BIGINT) AS peak_rpm FROM daily JOIN peaks USING (user_id, provider, model, day) GROUP BY 1, 2, 3, 4""")
def usage_daily(spark, sf_dir):
    return state.usage(W.calls(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"{C} SELECT provider, CAST(max(n) AS BIGINT) AS peak_rpm FROM (SELECT provider, count(*) OVER (PARTITION BY provider ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM calls) GROUP BY 1")
def peak_rpm(spark, sf_dir):
    return state.peak_per_minute(W.calls(spark, sf_dir), ["provider"])


@query(f"{C} SELECT user_id, provider, model, CAST(CAST(timezone('Asia/Jerusalem', timezone('UTC', ts)) AS DATE) AS STRING) AS day, CAST(2 * count(*) AS BIGINT) AS requests, CAST(2 * sum(tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1, 2, 3, 4")
def usage_merge(spark, sf_dir):
    own = state.usage(W.calls(spark, sf_dir))
    return state.add_usage(own, own).select("user_id", "provider", "model", F.col("day").cast("string").alias("day"), "requests", "tokens")


@query(f"""{C}, n AS (SELECT provider, ord, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS asked, row_number() OVER (PARTITION BY provider ORDER BY date_trunc('second', ts), ord) - 1 AS i FROM calls)
SELECT provider, ord, round(i * 13.2 + max(asked - i * 13.2) OVER (PARTITION BY provider ORDER BY i), 3) AS start FROM n""")
def rate_limit_schedule(spark, sf_dir):
    calls = W.calls(spark, sf_dir).select("provider", "ord", F.unix_timestamp("ts").cast("double").alias("at"))
    return state.rate_limited(calls, ["provider"], state.min_interval(5, 1.1)).select("provider", "ord", F.round("start", 3).alias("start"))


@query(f"{C} SELECT provider, ord, CAST((row_number() OVER (PARTITION BY provider ORDER BY ord) - 1) % 3 AS INT) AS account FROM calls")
def round_robin(spark, sf_dir):
    return state.round_robin(W.calls(spark, sf_dir), ["provider"], 3).select("provider", "ord", "account")


@query("""SELECT o_orderkey, CAST(CASE WHEN a + s > n THEN a + s ELSE a + s * (floor((n - a) / s) + 1) END AS BIGINT) AS next_run FROM (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS a, greatest(1, o_orderkey % 50) * 3600 AS s, CAST(epoch(TIMESTAMP '2024-01-20 12:34:56') AS BIGINT) AS n FROM orders)""")
def next_run_anchored(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", F.unix_timestamp(dates.next_anchored(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 50, W.now())).alias("next_run"))


@query("SELECT event_id, CAST(CAST(timezone('Asia/Jerusalem', timezone('UTC', ts)) AS DATE) AS STRING) AS day, CAST(epoch(timezone('Asia/Jerusalem', date_trunc('day', timezone('Asia/Jerusalem', timezone('UTC', ts))))) AS BIGINT) AS day_start FROM events")
def budget_day(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", dates.budget_day(F.col("ts")).cast("string").alias("day"), F.unix_timestamp(dates.budget_day_start(F.col("ts"))).alias("day_start"))


@query(f"WITH {W.USERS_SQL}, {W.CALLS_SQL}, used AS (SELECT user_id, count(*) AS n FROM calls WHERE ts >= TIMESTAMP '2024-01-19 22:00:00' GROUP BY 1) SELECT user_id, coalesce(n, 0) AS used, is_admin OR coalesce(n, 0) < 2 AS allowed FROM users LEFT JOIN used USING (user_id)")
def runs_used_today(spark, sf_dir):
    runs = W.calls(spark, sf_dir).select("user_id", F.col("ts").alias("started_at"))
    return state.may_run(W.users(spark, sf_dir), runs, W.now()).select("user_id", "used", "allowed")


@query(f"""WITH {W.USERS_SQL}, q AS (SELECT concat('u', CAST(o_custkey AS STRING)) AS user_id, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT user_id, CAST(n AS INT) AS queries FROM users JOIN q USING (user_id) WHERE is_active AND frequency_hours <= 12 AND is_whitelisted AND trim(cv_text) <> ''""")
def due_users(spark, sf_dir):
    users = W.users(spark, sf_dir)
    preferences = users.select("user_id", "is_active", (W.now() + F.make_dt_interval(hours=(F.col("frequency_hours") - 12).cast("int"))).alias("next_run_at"))
    searches = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"), F.col("o_orderpriority").alias("search_term"), F.col("o_orderstatus").alias("location"), (F.col("o_orderkey") % 3 != 0).alias("is_active"))
    return state.due_users(preferences, users.select("user_id", "is_whitelisted", "cv_text"), searches, W.now()).select("user_id", F.size("queries").alias("queries"))


@query(f"{U}, d AS (SELECT user_id, max(o_orderdate) AS last FROM users LEFT JOIN orders ON user_id = concat('u', CAST(o_custkey AS STRING)) GROUP BY 1) SELECT user_id FROM d WHERE last IS NULL OR last < TIMESTAMP '1998-01-06 00:00:00' - INTERVAL 5 DAYS")
def digest_due(spark, sf_dir):
    last = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("last_digest_at"))
    return state.digest_due(W.users(spark, sf_dir).select("user_id").join(last, "user_id", "left"), F.lit("1998-01-06").cast("timestamp")).select("user_id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1996-06-01 00:00:00' - INTERVAL 90 DAYS AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3))")
def retention_results(spark, sf_dir):
    results = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    marks = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 3").select(F.col("l_orderkey").alias("job_result_id"))
    return state.purge_results(results, marks, F.lit("1996-06-01").cast("timestamp")).select("id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAYS")
def retention_seen(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.purge(events, "ts", F.lit("2024-04-15").cast("timestamp"), V.LOOKBACK_DAYS["seen_purge"]).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:34:56' - INTERVAL 14 DAYS ORDER BY ts DESC, event_id LIMIT 50")
def ttl_cap_cache(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.newest(state.prune_history(events, W.now(), at="ts"), [F.desc("ts"), F.asc("event_id")], 50).select("event_id")


@query("""WITH e AS (SELECT sha256(CAST(event_id % 3000 AS STRING)) AS hash, ts, event_id FROM events), old AS (SELECT hash, min(ts) AS ts FROM e WHERE event_id % 2 = 0 GROUP BY 1), new AS (SELECT hash, max(ts) AS ts FROM e WHERE event_id % 2 = 1 GROUP BY 1),
merged AS (SELECT coalesce(o.hash, n.hash) AS hash, coalesce(o.ts, n.ts) AS ts FROM old o FULL JOIN new n USING (hash)) SELECT hash FROM merged WHERE ts >= TIMESTAMP '2024-01-20 12:34:56' - INTERVAL 14 DAYS ORDER BY ts DESC, hash LIMIT 600""")
def text_cache(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.sha2((F.col("event_id") % 3000).cast("string"), 256).alias("hash"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    old = e.where("event_id % 2 = 0").groupBy("hash").agg(F.min("ts").alias("ts"))
    new = e.where("event_id % 2 = 1").groupBy("hash").agg(F.max("ts").alias("ts"))
    return state.text_cache(old, new, W.now(), 600).select("hash")


@query("SELECT doc_id, sha256(text) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.text = documents.text AND b.lang = 'de')")
def embedding_cache_misses(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    cache = docs.where("lang = 'de'").select(F.sha2("text", 256).alias("hash")).distinct()
    missed = state.missing_texts(docs.select("text"), cache)
    return missed.join(docs.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id")), "hash").select("doc_id", "hash")


@query(f"{J} SELECT user_id, job_url, max(ord) AS ord FROM jobs GROUP BY 1, 2")
def history_upsert(spark, sf_dir):
    j = W.jobs(spark, sf_dir).select("user_id", "job_url", "ord")
    return state.upsert_latest(j.where("ord % 2 = 0"), j.where("ord % 2 = 1"), ["user_id", "job_url"], "ord")


# feedback


@query("SELECT conv_id, count(*) AS n, string_agg(concat(role, ': ', length(text)), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def digest_input(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return state.digest_input(talk, F.concat(F.col("role"), F.lit(": "), F.length("text").cast("string")), ["conv_id"], "turn").withColumn("n", F.col("n").cast("bigint"))


KINDS = "CASE turn % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'block_company' WHEN 2 THEN 'nonsense' ELSE 'other' END"


def entries(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return talk.select("conv_id", "turn", F.expr(KINDS).alias("feedback_type"), F.expr("CASE WHEN conv_id % 6 = 0 THEN ' ' ELSE concat('https://x/', CAST(conv_id AS STRING)) END").alias("job_url"), F.expr("concat('Firm ', CAST(conv_id % 20 AS STRING))").alias("company"), F.col("role").alias("title"), F.lit(None).cast("string").alias("location"), F.col("text").alias("note"), F.lit("2024-01-01").alias("date"))


ENTRIES = f"entries AS (SELECT conv_id, turn, {KINDS} AS feedback_type, CASE WHEN conv_id % 6 = 0 THEN ' ' ELSE concat('https://x/', CAST(conv_id AS STRING)) END AS job_url, concat('Firm ', CAST(conv_id % 20 AS STRING)) AS company, role AS title, text AS note FROM conversations)"


@query(f"WITH {ENTRIES} SELECT feedback_type, company, count(*) AS n, CAST(sum(least(length(note), 1000)) AS BIGINT) AS length FROM entries WHERE feedback_type IN ('applied', 'block_company', 'other') AND trim(job_url) <> '' GROUP BY 1, 2")
def feedback_sanitised(spark, sf_dir):
    return state.sanitised(entries(spark, sf_dir)).groupBy("feedback_type", "company").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("note")).cast("bigint").alias("length"))


@query(f"WITH {ENTRIES} SELECT DISTINCT lower(company) AS pattern FROM entries WHERE feedback_type = 'block_company' UNION SELECT 'firm 1' UNION SELECT 'acme'")
def blocked_companies(spark, sf_dir):
    old = spark.createDataFrame([("firm 1",), ("acme",)], "pattern string")
    return state.blocked_companies(old, entries(spark, sf_dir))


@query("SELECT doc_id AS feedback_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def feedback_needs_vector(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("feedback_id"))
    return state.needing_vectors(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("feedback_id")))


@query("SELECT conv_id AS user_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS position, CAST(turn AS STRING) AS entry FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 2")
def feedback_missing_suffix(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    log = talk.groupBy(F.col("conv_id").alias("user_id")).agg(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.cast("string")).alias("entries")).withColumn("vectors", F.slice("entries", 1, 2))
    return state.missing_suffix(log)


@query("SELECT conv_id AS user_id, count(*) AS n FROM conversations GROUP BY 1")
def feedback_counts(spark, sf_dir):
    return state.feedback_counts(spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "user_id"))


@query(f"WITH {ENTRIES} SELECT conv_id, turn, concat('[', feedback_type, '] ', title, ' @ ', company) AS line FROM entries")
def feedback_line(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.select("conv_id", "turn", text.feedback_text(F.col("feedback_type"), F.col("title"), F.col("company"), F.lit(None).cast("string"), F.col("location")).alias("line"))


# statistics


@query(f"{J} SELECT user_id, count(*) AS scraped, count(*) FILTER (WHERE ord % 2 = 0) AS filtered, count(*) FILTER (WHERE ord % 4 = 0) AS ai_evaluated, count(*) FILTER (WHERE ord % 8 = 0) AS approved, count(*) FILTER (WHERE ord % 4 = 2) AS lower_ranked FROM jobs GROUP BY 1")
def run_stats(spark, sf_dir):
    k = F.col("ord")
    return state.run_stats(W.jobs(spark, sf_dir).withColumns({"filtered": k % 2 == 0, "ai_evaluated": k % 4 == 0, "approved": k % 8 == 0, "lower_ranked": k % 4 == 2}), ["user_id"])


@query(f"{J} SELECT user_id, CAST(min(similarity) AS DOUBLE) AS least, CAST(max(similarity) AS DOUBLE) AS most, round(CAST(median(similarity) AS DOUBLE), 6) AS middle FROM jobs GROUP BY 1")
def similarity_summary(spark, sf_dir):
    return state.similarity_summary(W.jobs(spark, sf_dir).withColumn("similarity", F.col("similarity").cast("double")), ["user_id"]).withColumn("middle", F.round("middle", 6))


@query(f"{J} SELECT user_id, count(similarity) AS n, CAST(min(similarity) AS DOUBLE) AS least, CAST(max(similarity) AS DOUBLE) AS most, true AS within FROM jobs GROUP BY 1 HAVING count(similarity) > 0")
def similarity_sketch(spark, sf_dir):
    """Sketches of three runs, merged: the share of a user's rows below the sketch's middle is a half, but for the stated error."""
    jobs = W.jobs(spark, sf_dir).withColumn("similarity", F.col("similarity").cast("double"))
    runs = [state.similarity_sketches(jobs.where(F.col("ord") % 3 == n), ["user_id"]) for n in range(3)]
    merged = state.merged_sketches(runs[0].unionByName(runs[1]).unionByName(runs[2]), ["user_id"])
    told = state.summary_of(merged, ["user_id"])
    below = jobs.join(told, "user_id").groupBy("user_id").agg(F.count_if(F.col("similarity") < F.col("middle")).alias("below"), F.count_if(F.col("similarity") <= F.col("middle")).alias("upto"))
    # each merge of runs may add the bound once more
    slack = F.ceil(F.col("n") * 3 * state.SKETCH_ERROR) + 1
    return merged.join(below, "user_id").select("user_id", "n", "least", "most", ((F.col("below") <= F.col("n") / 2 + slack) & (F.col("upto") >= F.col("n") / 2 - slack)).alias("within"))


@query(f"{J} SELECT source, count(*) AS n FROM jobs GROUP BY 1")
def source_counts(spark, sf_dir):
    return local.source_counts(W.jobs(spark, sf_dir))


@query(f"{J} SELECT ord FROM jobs WHERE NOT coalesce(starts_with(source, 'ats_') AND posted < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 60 DAYS, false)")
def stale_ats(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir)
    return jobs.where(~filters.stale(F.col("source"), F.col("posted").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"))).select("ord")


@query(f"{J} SELECT ord FROM jobs WHERE NOT (coalesce(starts_with(source, 'ddg_'), false) AND ord % 4000 % 3 = 0)")
def dead_urls(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir)
    n = F.regexp_extract("job_url", r"(\d+)$", 1).cast("int")
    probes = jobs.select("job_url").distinct().where(n % 2 >= 0).select("job_url", F.when(n % 3 == 0, F.when(n % 2 == 0, 404).otherwise(200)).otherwise(200).alias("status"), F.when((n % 3 == 0) & (n % 2 == 1), "https://x/position-closed").otherwise(F.col("job_url")).alias("final_url"))
    return filters.drop_dead(jobs, probes).select("ord")


# coercion and verdicts

SCORE = "least(100, greatest(0, coalesce(CAST(trunc(TRY_CAST(nullif(regexp_extract(coalesce(match_text, ''), '^\\s*(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)) AS INT), 0)))"


@query(f"{J} SELECT ord, CAST({SCORE} AS INT) AS score FROM jobs")
def score_coercion(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", coerce.score(F.col("match_text")).cast("int").alias("score"))


@query(f"{J} SELECT ord, lower(origin) AS origin, CASE WHEN lower(job_type) IN ('low', 'medium', 'high') THEN job_type ELSE 'unknown' END AS effort, CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) END AS title, round(similarity, 3) AS similarity FROM jobs")
def db_coercions(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", coerce.origin(F.col("origin")).alias("origin"), coerce.effort(F.col("job_type")).alias("effort"), coerce.optional_text(F.col("title")).alias("title"), F.round(coerce.similarity(F.col("similarity")), 3).alias("similarity"))


def _verdicts(spark, sf_dir):
    jobs = W.flagged(spark, sf_dir)
    value = F.concat(F.lit('{"verdict": "a {good} \\"fit\\"", "is_valid": "yes", "tech_fit": '), F.col("tech_fit").cast("string"), F.lit(', "match_percentage": "'), F.coalesce("match_text", F.lit("")), F.lit('", "suspicious": '), F.col("suspicious").cast("string"), F.lit("}"))
    shape = F.when(F.col("ord") % 3 == 0, value).when(F.col("ord") % 3 == 1, F.concat(F.lit("```json\n"), value, F.lit("\n```"))).otherwise(F.concat(F.lit("Here you are: "), value, F.lit(" {so} it is")))
    return jobs.withColumn("answer", shape)


BLACK = "coalesce(low, false)"
CAPPED = f"CASE WHEN {BLACK} OR suspicious THEN least(55, {SCORE}) ELSE {SCORE} END"


@query(f"{FL} SELECT ord, CAST({CAPPED} AS INT) AS match, concat(CASE WHEN {BLACK} THEN '[BLACKLISTED] ' WHEN suspicious AND {SCORE} > 55 THEN '[AI-SUSPICIOUS] ' ELSE '' END, 'a {{good}} \"fit\"') AS verdict, suspicious, true AS is_valid, CAST(tech_fit AS INT) AS tech_fit FROM flagged".replace("tech_fit AS INT) AS tech_fit", "least(100, tech_fit) AS INT) AS tech_fit"))
def verdict_caps(spark, sf_dir):
    return verdict.judged(_verdicts(spark, sf_dir), F.col("answer")).select("ord", F.col("verdict").alias("v")).select("ord", F.col("v.match_percentage").alias("match"), "v.verdict", "v.suspicious", "v.is_valid", "v.tech_fit")


NESTED = """concat('{"a": "}{\\" ', ord, ' ]", "b": {"c": "', company, '", "d": {"e": ', ord, '}}}')"""


@query(f"{J} SELECT ord, CASE WHEN ord % 5 > 0 THEN {NESTED} END AS found FROM jobs")
def balanced_json(spark, sf_dir):
    """An object with braces in its strings, between noise of the row's own; each fifth row's object never ends."""
    jobs = W.jobs(spark, sf_dir)
    own = F.concat(F.lit('{"a": "}{\\" '), F.col("ord").cast("string"), F.lit(' ]", "b": {"c": "'), "company", F.lit('", "d": {"e": '), F.col("ord").cast("string"), F.lit("}}}"))
    cut = F.when(F.col("ord") % 5 > 0, F.concat(own, F.lit(" tail } {"))).otherwise(F.substring(own, F.lit(1), F.length(own) - 1))
    return jobs.select("ord", verdict.balanced_object(F.concat(F.lit("noise ] "), F.coalesce("title", F.lit("")), F.lit(" "), cut)).alias("found"))


@query(f"{J} SELECT ord, CAST(round(tech_fit * 0.5 + 10 * 0.3 + 20 * 0.2, 6) AS DOUBLE) AS composite FROM jobs")
def composite_score(spark, sf_dir):
    v = F.struct(F.col("tech_fit").alias("tech_fit"), F.lit(10).alias("experience_fit"), F.lit(20).alias("logistics_fit"))
    return W.jobs(spark, sf_dir).select("ord", F.round(verdict.composite(v).cast("double"), 6).alias("composite"))


PROMPTED = "length(concat('Rate how the candidate fits the posting.', chr(10), 'Candidate:', chr(10), 'profile', chr(10), 'Posting: ', coalesce(title, ''), ' at ', coalesce(company, ''), ', ', coalesce(location, ''), chr(10), substr(coalesce(description, ''), 1, 5000))) % 100"


@query(f"""{FL}, parts AS (SELECT ord, low, title, company, location, description, lower(coalesce(title, '')) AS t, lower(coalesce(description, '')) AS d, trim(lower(coalesce(description, ''))) AS b, lower(coalesce(source, '')) AS s, lower(coalesce(origin, '')) AS o, trim(coalesce(location, '')) AS place FROM flagged),
needs AS (SELECT *, trim({_requirement_sql()}) AS need FROM parts), g AS (SELECT *, {REASON} AS reason, {PROMPTED} AS told FROM needs)
SELECT ord, CAST(CASE WHEN reason IS NOT NULL THEN 0 WHEN coalesce(low, false) THEN least(55, told) ELSE told END AS INT) AS match_percentage,
  CASE WHEN reason IS NOT NULL THEN concat('Pre-screen skipped: ', reason) WHEN coalesce(low, false) THEN '[BLACKLISTED] ok' ELSE 'ok' END AS verdict FROM g""")
def model_scoring(spark, sf_dir):
    def model(prompts):
        import pandas as pd

        return pd.Series(['{"is_valid": true, "verdict": "ok", "match_percentage": %d}' % (len(p) % 100) for p in prompts])

    gated = viability.gate(W.flagged(spark, sf_dir))
    return verdict.evaluate(gated, model, verdict.prompt(F.lit("profile"))).select("ord", "verdict.match_percentage", "verdict.verdict")


TURNS = """WITH t AS (SELECT o_orderkey AS ord, o_orderkey % 4 AS p, o_orderkey % 3 AS s FROM orders),
tried AS (SELECT *, p IN (1, 2) AS second_, p IN (1, 2) AND s <> 2 AS third_, p = 1 AND s = 1 AS fourth_ FROM t)"""


def _asked(spark, sf_dir):
    """Two models that fail by rule: the first is down for some prompts, at the first attempt for others; the second cannot take some
    prompts at all and stumbles once over others."""

    def first(prompts, attempt):
        numbers = [int(p.rsplit(" ", 1)[1]) for p in prompts]
        return [hooks.ModelError("503 UNAVAILABLE") if n % 4 == 1 else hooks.ModelError("429 slow down") if n % 4 == 2 and attempt == 0 else f"first {n}" for n in numbers]

    def second(prompts, attempt):
        numbers = [int(p.rsplit(" ", 1)[1]) for p in prompts]
        return [hooks.ModelError("413 Request too large") if n % 3 == 0 else hooks.ModelError("boom") if n % 3 == 1 and attempt == 1 else f"second {n}" for n in numbers]

    orders = W.spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ord")))
    models = [hooks.Model("first", first), hooks.Model("second", second, size_is_final=True)]
    return hooks.ask_in_turn(orders, F.concat(F.lit("prompt "), F.col("ord").cast("string")), models)


@query(f"""{TURNS} SELECT ord, CASE WHEN p IN (0, 3) THEN concat('first ', ord) WHEN s = 2 THEN concat('second ', ord) WHEN p = 2 THEN concat('first ', ord) WHEN s = 1 THEN concat('second ', ord) END AS answer,
  CASE WHEN p IN (0, 3) THEN 'first' WHEN s = 2 THEN 'second' WHEN p = 2 THEN 'first' WHEN s = 1 THEN 'second' END AS answer_model FROM tried""")
def model_answers(spark, sf_dir):
    return _asked(spark, sf_dir).select("ord", "answer", "answer_model")


@query(f"""{TURNS} SELECT ord, 0 AS number, 'first' AS model, CASE WHEN second_ THEN 'retryable' ELSE 'ok' END AS kind FROM tried
UNION ALL SELECT ord, 1, 'second', CASE s WHEN 0 THEN 'too_large' WHEN 1 THEN 'other' ELSE 'ok' END FROM tried WHERE second_
UNION ALL SELECT ord, 2, 'first', CASE p WHEN 1 THEN 'retryable' ELSE 'ok' END FROM tried WHERE third_
UNION ALL SELECT ord, 3, 'second', 'ok' FROM tried WHERE fourth_""")
def model_attempts(spark, sf_dir):
    return hooks.attempt_rows(_asked(spark, sf_dir), ["ord"]).select("ord", "number", "model", "kind")


@query(f"{J} SELECT ord, CASE WHEN contains(title, 'Staff') THEN NULL ELSE concat(title, ' a ', title, ' b') END AS snippets, CASE WHEN contains(title, 'Staff') THEN 'quota' END AS error FROM jobs WHERE title IS NOT NULL UNION ALL SELECT ord, NULL, NULL FROM jobs WHERE title IS NULL")
def snippet_hook(spark, sf_dir):
    provider = lambda queries: [hooks.ModelError("quota") if "Staff" in q else [f"{q} a", f"{q} b", "c"] for q in queries]
    jobs = hooks.with_snippets(W.jobs(spark, sf_dir), F.col("title"), provider, most=2)
    return jobs.select("ord", F.nullif("snippets", F.lit("")).alias("snippets"), F.col("snippets_error").alias("error"))


#: What a search may say of a company: two of the words, one, one that holds another, or none.
REPORTS = "CASE ord % 4 WHEN 0 THEN 'they did not pay, a SCAM' WHEN 1 THEN 'fraud, it is said' WHEN 2 THEN 'a fraudulent posting' ELSE description END"


@query(f"{J} SELECT ord, {W.any_of("lower(concat(coalesce(location, ''), ' ', coalesce(company, '')))", V.INDIA_SIGNALS)} AS india, ord % 4 IN (0, 2) AS scam FROM jobs")
def india_scam_signals(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir).withColumn("told", F.expr(REPORTS))
    return jobs.select("ord", text.has_any(F.concat_ws(" ", F.coalesce("location", F.lit("")), F.coalesce("company", F.lit(""))), V.INDIA_SIGNALS).alias("india"), (text.scam_hits(F.col("told"), V.SCAM_WORDS) >= 2).alias("scam"))


# text, addresses, hashes


def _html_sql(c: str) -> str:
    out = c
    for tag in ("script", "style", "noscript", "svg"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, sign in text.ENTITIES:
        out = f"replace({out}, '{name}', {quoted(sign)})"
    out = f"replace(replace({out}, '&#39;', ''''), '&#34;', '\"')"
    return strip_sql(f"regexp_replace({out}, '\\s+', ' ', 'g')")


@query(f"SELECT page_id, md5({_html_sql('html')}) AS text_md5 FROM pages")
def html_to_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(text.html_to_text(F.col("html"))).alias("text_md5"))


URL = "concat(CASE page_id % 6 WHEN 0 THEN replace(url, '/en/', '/jobs/') WHEN 1 THEN concat(url, '/careers/') WHEN 2 THEN replace(url, '/en/', '/blog/jobs/') WHEN 3 THEN 'https://www.linkedin.com/posts/acme_hiring-activity-7397512345678901234' WHEN 4 THEN concat(url, '/jobs/engineer-12') ELSE url END, '')"


@query(f"""WITH u AS (SELECT page_id, {URL} AS u FROM pages), l AS (SELECT *, CASE WHEN {matches('u', urls.OTHER)} THEN contains(lower(u), 'linkedin.com/posts/') ELSE {matches('u', urls.JOB)} END AS job_like FROM u)
SELECT page_id, job_like, job_like AND NOT {matches("regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)", urls.LANDING)} AS specific FROM l""")
def url_shape(spark, sf_dir):
    u = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(URL).alias("u"))
    return u.select("page_id", urls.job_like(F.col("u")).alias("job_like"), urls.specific_job_like(F.col("u")).alias("specific"))


@query("SELECT page_id, replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'www.', '') AS domain FROM pages")
def extract_domain(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("SELECT page_id, concat('Acme-', page_id % 7) AS handle, page_id % 7 = 3 AS fits FROM pages")
def linkedin_handle(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", (F.col("page_id") % 7).cast("string").alias("k"))
    url = F.concat(F.lit("https://www.LinkedIn.com/company/Acme-"), F.col("k"), F.lit("/jobs"))
    company = F.when(F.col("k") == "3", "The Acme Group").otherwise("AB Zu 12")
    return p.select("page_id", urls.linkedin_handle(url).alias("handle"), urls.handle_matches(urls.linkedin_handle(url), company).alias("fits"))


@query(f"{J} SELECT ord, CAST(epoch(posted) AS BIGINT) * 1000 AS ms FROM jobs WHERE posted >= TIMESTAMP '1993-01-01 00:00:00'")
def snowflake_date(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir).where("posted >= timestamp_ntz'1993-01-01'")
    made = F.shiftleft(F.unix_timestamp(F.col("posted").cast("timestamp")) * 1000, 22) + F.col("ord") % 4096
    url = F.concat(F.lit("https://www.linkedin.com/posts/acme_x-activity-"), made.cast("string"), F.lit("-abcd"))
    return jobs.select("ord", F.unix_millis(dates.linkedin_posted(url)).alias("ms"))


@query(f"{U} SELECT user_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 65), lambda i: (strpos('0123456789abcdef', substr(sha256(user_id), i, 1)) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 7) AS BIGINT) AS shard FROM users")
def user_shard(spark, sf_dir):
    return W.users(spark, sf_dir).select("user_id", hashing.shard(F.col("user_id"), 7).alias("shard"))


@query(f"{U} SELECT user_id, sha256(user_id) AS hash, substr(sha256(coalesce(cv_text, '')), 1, 16) AS cv_key FROM users")
def token_hash(spark, sf_dir):
    return W.users(spark, sf_dir).select("user_id", hashing.token_hash(F.col("user_id")).alias("hash"), hashing.cv_key(F.col("cv_text")).alias("cv_key"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('b', c_custkey, ',e', c_custkey) WHEN 1 THEN concat('b', c_custkey) ELSE concat('a', c_custkey) END AS own, CASE WHEN c_custkey % 4 = 1 THEN 'k1' ELSE concat('k', c_custkey % 4, ',k1') END AS keys FROM customer")
def shard_slice(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    entry = lambda *names: F.concat(*[x for n in names for x in (F.lit(n), k, F.lit(","))])
    csv = F.when(F.col("c_custkey") % 3 == 0, entry(" a", "b", "c", " d", "e")).when(F.col("c_custkey") % 3 == 1, entry("a", " b")).otherwise(entry(" ,a"))
    again = F.concat(F.lit("k"), (F.col("c_custkey") % 4).cast("string"), F.lit(",k1, k"), (F.col("c_custkey") % 4).cast("string"), F.lit(",, k1"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array_join(hashing.strided(csv, 1, 3), ",").alias("own"), F.array_join(hashing.key_list(again), ",").alias("keys"))


@query(f"{U} SELECT user_id, concat(substr(user_id, 1, 1), '***', CASE WHEN length(user_id) > 2 THEN right(user_id, 1) ELSE '' END, '@example.com') AS email, concat(user_id, '/name', length(user_id)) AS repo FROM users")
def redaction(spark, sf_dir):
    u = W.users(spark, sf_dir)
    address = F.concat(F.lit(" https://github.com/"), "user_id", F.lit("/name"), F.length("user_id").cast("string"), F.lit(".git "))
    return u.select("user_id", text.redact_email(F.concat("user_id", F.lit("@example.com"))).alias("email"), text.normalize_repo(address).alias("repo"))


# digests


def _digest_rows(spark, sf_dir):
    jobs = W.flagged(spark, sf_dir).withColumns({"match_percentage": F.col("match_text"), "verdict": F.lit("MATCH: fine <b>")})
    return dedup.ranked(jobs, ["user_id"], [F.asc("ord")], 12)


CELL = f"CASE WHEN {NUMBER} IS NULL OR {NUMBER} < 0 THEN 'N/A' ELSE concat(CAST(trunc({NUMBER}) AS INT), '%') END"
FLAG = f"concat(CASE WHEN scam THEN '🚨 ' WHEN {BLACK} THEN '🚫 ' WHEN suspicious THEN '⚠️ ' ELSE '' END, coalesce(title, ''))"
RANKED12 = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS rank FROM flagged QUALIFY rank <= 12)"
ESC = lambda c: f"replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
COLOR = f"CASE WHEN {NUMBER} >= 85 THEN '#22c55e' WHEN {NUMBER} >= 70 THEN '#eab308' WHEN {NUMBER} >= 0 THEN '#ef4444' ELSE '#9ca3af' END"
HTML = f"concat('<tr><td><span style=\"color:', {COLOR}, '\">', {CELL}, '</span></td><td><a href=\"', job_url, '\">', {ESC(FLAG)}, '</a></td><td>', {ESC('company')}, '</td><td>', {ESC('location')}, '</td><td><strong>MATCH:</strong> fine &lt;b&gt;</td></tr>')"


@query(f"{FL}, {RANKED12} SELECT user_id, md5(concat({quoted(render.FORMATS['html'][1])}, string_agg({HTML}, '' ORDER BY rank), '</table>')) AS document FROM r GROUP BY 1")
def digest_html(spark, sf_dir):
    return render.digest(_digest_rows(spark, sf_dir), ["user_id"], "html").select("user_id", F.md5("document").alias("document"))


BAR = lambda c: f"replace(coalesce({c}, ''), '|', '\\|')"


@query(f"{FL}, {RANKED12} SELECT user_id, md5(concat({quoted(render.FORMATS['markdown'][1])}, string_agg(concat('| ', {CELL}, ' | [', {BAR(FLAG)}, '](', job_url, ') | ', {BAR('company')}, ' | ', {BAR('location')}, ' | **MATCH:** fine <b> |'), chr(10) ORDER BY rank), chr(10))) AS document FROM r GROUP BY 1")
def digest_markdown(spark, sf_dir):
    return render.digest(_digest_rows(spark, sf_dir), ["user_id"], "markdown").select("user_id", F.md5("document").alias("document"))


@query(f"{FL}, {RANKED12} SELECT user_id, md5(concat(string_agg(concat('- ', {CELL}, ' ', {FLAG}, ' (', coalesce(company, ''), ', ', coalesce(location, ''), ') ', job_url), chr(10) ORDER BY rank), chr(10))) AS document FROM r GROUP BY 1")
def digest_text(spark, sf_dir):
    return render.digest(_digest_rows(spark, sf_dir), ["user_id"], "text").select("user_id", F.md5("document").alias("document"))


def _section_sql(name: str, optional: bool, title: str) -> str:
    rows = f"string_agg({HTML}, '' ORDER BY rank) FILTER (section = '{name}')"
    n = f"count(*) FILTER (section = '{name}')"
    table = f"concat({quoted(render.FORMATS['html'][1])}, {rows}, '</table>')"
    body = f"concat('<h2>{title} (', {n}, ')</h2>', CASE WHEN {n} > 0 THEN {table} ELSE '<p>{render.NOTHING}</p>' END)"
    return f"CASE WHEN {n} > 0 THEN {body} ELSE '' END" if optional else body


ASKED = "CASE WHEN substr(user_id, 2)::INT % 3 > 0 THEN concat('<p><a href=\"https://example.com/f?a=1&amp;u=', user_id, '\">" + render.ASK + "</a></p>') ELSE '' END"


@query(f"""{FL}, r AS (SELECT *, CASE WHEN contains(lower(coalesce(title, '')), 'intern') OR job_type = 'internship' THEN 'internship' WHEN ord % 4 = 0 AND substr(user_id, 2)::INT % 2 = 0 THEN 'lower' ELSE 'job' END AS section,
  row_number() OVER (PARTITION BY user_id ORDER BY ord) AS rank FROM flagged QUALIFY rank <= 12), s AS (SELECT user_id, count(*) AS scraped, count(*) FILTER (ord % 2 = 0) AS filtered FROM jobs GROUP BY 1)
SELECT user_id, CAST(count(*) FILTER (section <> 'lower') AS INT) AS n, md5(concat({quoted(render.FRAMES['html'][0])}, '<p>Scraped: ', any_value(scraped), ', filtered to: ', any_value(filtered), ', shown: ', count(*) FILTER (section <> 'lower'), '</p>', {ASKED},
  {', '.join(_section_sql(name, optional, title) for name, title, optional in render.SECTIONS)}, {ASKED}, '</body></html>')) AS document FROM r JOIN s USING (user_id) GROUP BY user_id""")
def digest_document(spark, sf_dir):
    """Whole digests: run counts, feedback links, internships, jobs and what was found below the cut."""
    rows = _digest_rows(spark, sf_dir)
    lower = (F.col("ord") % 4 == 0) & (F.substring("user_id", 2, 9).cast("int") % 2 == 0)
    rows = rows.withColumn("section", F.when(ranking.is_internship(F.col("title"), F.col("job_type")), "internship").when(lower, "lower").otherwise("job"))
    stats = W.jobs(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("scraped"), F.count_if(F.col("ord") % 2 == 0).alias("filtered"))
    link = F.when(F.substring("user_id", 2, 9).cast("int") % 3 > 0, F.concat(F.lit("https://example.com/f?a=1&u="), "user_id"))
    return render.document(rows, stats, ["user_id"], "html", link).select("user_id", "n", F.md5("document").alias("document"))


@query("SELECT n_nationkey, concat(CASE n_nationkey WHEN 0 THEN 'No strong matches today' WHEN 1 THEN '1 job matches your CV' ELSE concat(n_nationkey, ' jobs match your CV') END, ' (Jan 20)') AS subject FROM nation")
def email_subject(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select("n_nationkey", render.subject(F.col("n_nationkey"), W.now()).alias("subject"))


@query(f"{J} SELECT ord, CASE WHEN similarity IS NULL THEN '—' ELSE concat(CAST(CAST(round_even(similarity::DOUBLE * 100, 0) AS INT) AS STRING), '%') END AS shown FROM jobs")
def score_percent(spark, sf_dir):
    return W.jobs(spark, sf_dir).select("ord", coerce.percent(F.col("similarity").cast("double")).alias("shown"))


# sets


@query(f"{J} SELECT ord, title, NULL::STRING AS extra FROM jobs UNION ALL SELECT ord, NULL, job_url FROM jobs")
def union_widening(spark, sf_dir):
    j = W.jobs(spark, sf_dir)
    return files.union_all(j.select("ord", "title"), j.select("ord", F.col("job_url").alias("extra"))).select("ord.ord", "title", "extra")


@query(f"{J} SELECT user_id, job_url, ord FROM (SELECT user_id, job_url, max(ord) AS ord FROM jobs GROUP BY 1, 2) a WHERE NOT EXISTS (SELECT 1 FROM jobs b WHERE b.origin = 'local' AND b.user_id = a.user_id AND b.job_url = a.job_url) UNION ALL SELECT user_id, job_url, min(ord) FROM jobs WHERE origin = 'local' GROUP BY 1, 2")
def keyed_overwrite(spark, sf_dir):
    j = W.jobs(spark, sf_dir)
    old = j.groupBy("user_id", "job_url").agg(F.max("ord").alias("ord"))
    new = j.where("origin = 'local'").groupBy("user_id", "job_url").agg(F.min("ord").alias("ord"))
    return files.replace_keyed(old, new, ["user_id", "job_url"])


# payloads: rows become a payload, and parsing it gives the rows again


def _payloads(spark, sf_dir, item, field=None, extra=(), where="true"):
    """Rows in lists of up to a 97th, each list a payload; null fields are missing there."""
    rows = W.jobs(spark, sf_dir).where(where)
    body = F.collect_list(item)
    return rows.groupBy((F.col("ord") % 97).alias("g"), *extra).agg(F.to_json(F.struct(body.alias(field)) if field else body).alias("payload"))


#: A day and a text of each row, in both languages.
DAY, ABOUT = "concat('2024-01-', lpad(CAST(ord % 28 + 1 AS STRING), 2, '0'))", "concat('About ', ord, ' & more')"
SEVEN = "title, company, location, job_url, description, job_type, date_posted".split(", ")


def _rows_sql(place: str, url: str = "job_url", about: str = "coalesce(description, '')", kind: str = "''", day: str = DAY, where: str = "true", company: str = "coalesce(company, '')") -> str:
    return f"{J} SELECT coalesce(title, '') AS title, {company} AS company, {place} AS location, {url} AS job_url, {about} AS description, {kind} AS job_type, {day} AS date_posted FROM jobs WHERE {where}"


UNSPECIFIED = "CASE WHEN coalesce(location, '') = '' THEN 'Remote/Unspecified' ELSE location END"
FULL = {"kind": "'fulltime'", "about": ABOUT}


def _seven(df):
    return df.select(*SEVEN)


def _s(**names):
    return F.struct(*[c.alias(n) for n, c in names.items()])


@query(_rows_sql("coalesce(location, 'Remote')"))
def parse_remotive(spark, sf_dir):
    item = _s(title=F.col("title"), company_name=F.col("company"), candidate_required_location=F.col("location"), url=F.col("job_url"), description=F.col("description"), publication_date=F.expr(DAY))
    return _seven(feeds.remotive(_payloads(spark, sf_dir, item, "jobs")))


@query(_rows_sql("'Remote'", day="CAST(1700000000 + ord AS STRING)", where="ord % 3 = 0"))
def parse_arbeitnow(spark, sf_dir):
    item = _s(title=F.col("title"), company_name=F.col("company"), remote=F.when(F.col("ord") % 3 == 0, True).when(F.col("ord") % 3 == 1, False), url=F.col("job_url"), description=F.col("description"), created_at=F.col("ord") + 1700000000)
    return _seven(feeds.arbeitnow(_payloads(spark, sf_dir, item, "data")))


@query(_rows_sql("coalesce(location, 'Remote')", where="ord % 4 <> 1"))
def parse_jobicy(spark, sf_dir):
    k = F.col("ord") % 4
    industry = F.when(k == 0, F.array(F.lit("Hotels"), F.lit("Software"))).when(k == 1, F.array(F.lit("Hotels"))).when(k == 2, F.array().cast("array<string>"))
    item = _s(jobTitle=F.col("title"), companyName=F.col("company"), jobGeo=F.col("location"), url=F.col("job_url"), jobIndustry=industry, jobDescription=F.col("description"), pubDate=F.expr(DAY))
    return _seven(feeds.jobicy(_payloads(spark, sf_dir, item, "jobs")))


@query(_rows_sql("coalesce(location, 'Remote')", where="ord % 3 <> 0"))
def parse_remoteok(spark, sf_dir):
    item = _s(position=F.col("title"), company=F.col("company"), location=F.col("location"), url=F.col("job_url"), legal=F.when(F.col("ord") % 3 == 0, "terms"), description=F.col("description"), date=F.expr(DAY))
    return _seven(feeds.remoteok(_payloads(spark, sf_dir, item)))


@query(_rows_sql("CASE WHEN coalesce(location, '') = '' THEN 'Remote' WHEN ord % 8 = 0 THEN concat(location, ', EU') ELSE location END", about="CASE WHEN ord % 3 = 0 THEN concat('Excerpt ', ord) ELSE coalesce(description, '') END"))
def parse_himalayas(spark, sf_dir):
    excerpt, third = F.concat(F.lit("Excerpt "), F.col("ord").cast("string")), F.col("ord") % 3 == 0
    texts = {"description": F.when(~third, F.coalesce("description", F.lit(""))).otherwise(""), "excerpt": F.when(third, excerpt).otherwise("")}
    item = lambda place: F.to_json(_s(title=F.col("title"), companyName=F.col("company"), locationRestrictions=place, guid=F.col("job_url"), applicationLink=F.lit(""), pubDate=F.expr(DAY), **texts))
    some = F.coalesce("location", F.lit("")) != ""
    one = F.when((F.col("ord") % 8 == 0) & some, item(F.array(F.col("location"), F.lit("EU")))).otherwise(item(F.col("location")))
    payloads = W.jobs(spark, sf_dir).groupBy(F.col("ord") % 97).agg(F.concat(F.lit('{"jobs": ['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("payload"))
    return _seven(feeds.himalayas(payloads))


@query(_rows_sql(UNSPECIFIED))
def parse_themuse(spark, sf_dir):
    item = _s(name=F.col("title"), company=_s(name=F.col("company")), locations=F.array(_s(name=F.col("location"))), refs=_s(landing_page=F.col("job_url")), contents=F.col("description"), publication_date=F.expr(DAY))
    return _seven(feeds.themuse(_payloads(spark, sf_dir, item, "results")))


TITLED = "coalesce(CASE WHEN ord % 7 = 0 THEN title ELSE company || ': ' || title END, '')"


@query(f"{J} SELECT CASE WHEN colon > 0 THEN trim(substr(raw, colon + 1)) ELSE trim(raw) END AS title, CASE WHEN colon > 0 THEN trim(substr(raw, 1, colon - 1)) ELSE '' END AS company, 'Remote' AS location, job_url, coalesce(description, '') AS description, '' AS job_type, {DAY} AS date_posted FROM (SELECT *, {TITLED} AS raw, instr({TITLED}, ':') AS colon FROM jobs)")
def parse_weworkremotely(spark, sf_dir):
    """Titles with a company before them, and some without."""
    titled = F.when(F.col("ord") % 7 == 0, F.col("title")).otherwise(F.concat("company", F.lit(": "), "title"))
    rows = W.jobs(spark, sf_dir).select(titled.alias("title"), F.col("job_url").alias("link"), F.when(F.col("ord") % 2 == 0, F.col("description")).alias("summary"), F.when(F.col("ord") % 2 == 1, F.col("description")).alias("description"), F.expr(DAY).alias("pubDate"))
    return _seven(feeds.weworkremotely(rows))


def _ats(spark, sf_dir, system, item, field=None, token="", where="true"):
    p = _payloads(spark, sf_dir, item, field, ["company"], where).withColumns({"token": F.lit(token), "system": F.lit(system)})
    return _seven(ats.dispatch(p))


def _either(name_a, name_b, value):
    """The value under the first name for even rows, under the second for odd ones."""
    even = F.col("ord") % 2 == 0
    return {name_a: F.when(even, value), name_b: F.when(~even, value)}


@query(_rows_sql(UNSPECIFIED, **FULL))
def parse_greenhouse(spark, sf_dir):
    content = F.concat(F.lit("&lt;p&gt;About "), F.col("ord").cast("string"), F.lit(" &amp;amp; more&lt;/p&gt;&lt;script&gt;x&lt;/script&gt;"))
    return _ats(spark, sf_dir, "greenhouse", _s(title=F.col("title"), absolute_url=F.col("job_url"), location=_s(name=F.col("location")), content=content, **_either("updated_at", "first_published", F.expr(DAY))), "jobs")


@query(_rows_sql(UNSPECIFIED, day="strftime(make_timestamp((1700000000 + ord) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')", **FULL))
def parse_lever(spark, sf_dir):
    item = _s(text=F.col("title"), hostedUrl=F.col("job_url"), categories=_s(location=F.col("location")), createdAt=(F.col("ord") + 1700000000) * 1000, **_either("descriptionPlain", "description", F.expr(ABOUT)))
    return _ats(spark, sf_dir, "lever", item)


@query(_rows_sql("concat_ws(', ', nullif(location, ''), 'Earth')", "concat('https://apply.workable.com/acme/j/', ord, '/')", **FULL))
def parse_workable(spark, sf_dir):
    item = _s(title=F.col("title"), location=_s(city=F.col("location"), country=F.lit("Earth")), description=F.expr(ABOUT), **_either("shortcode", "id", F.col("ord").cast("string")), **_either("published_on", "created_at", F.expr(DAY)))
    return _ats(spark, sf_dir, "workable", item, "jobs", "acme")


@query(_rows_sql(UNSPECIFIED, about=ABOUT, kind="CASE WHEN ord % 3 = 0 THEN 'internship' ELSE 'fulltime' END"))
def parse_ashby(spark, sf_dir):
    kind = F.when(F.col("ord") % 3 == 0, "Intern").when(F.col("ord") % 3 == 1, "FullTime")
    item = _s(title=F.col("title"), location=F.col("location"), employmentType=kind, **_either("jobUrl", "applyUrl", F.col("job_url")), **_either("descriptionPlain", "descriptionHtml", F.expr(ABOUT)), **_either("publishedAt", "updatedAt", F.expr(DAY)))
    return _ats(spark, sf_dir, "ashby", item, "jobs")


@query(_rows_sql(UNSPECIFIED, "concat('https://t.wd5.myworkdayjobs.com/site/job/', ord)", "''", "'fulltime'"))
def parse_workday(spark, sf_dir):
    item = _s(title=F.col("title"), externalPath=F.concat(F.lit("/job/"), F.col("ord").cast("string")), locationsText=F.col("location"), postedOn=F.expr(DAY))
    return _ats(spark, sf_dir, "workday", item, "jobPostings", "t|wd5|site")


@query(_rows_sql("CASE WHEN coalesce(location, '') = '' THEN 'Remote/Unspecified' WHEN ord % 97 % 3 = 1 THEN concat(location, ', EU') ELSE location END", about=ABOUT, kind="CASE WHEN ord % 5 = 0 THEN 'internship' ELSE 'fulltime' END"))
def parse_factorialhr(spark, sf_dir):
    """The three shapes of a payload, each with its own shape of places: a text, a list of objects, an object."""
    kind = F.when(F.col("ord") % 5 == 0, "Internship contract")
    some = F.coalesce("location", F.lit("")) != ""
    shapes = ((None, {"location": F.col("location")}), ("jobs", {"locations": F.when(some, F.array(_s(name=F.col("location"), city=F.lit("x")), _s(name=F.lit(None).cast("string"), city=F.lit("EU"))))}), ("data", {"city": F.when(some, _s(name=F.col("location")))}))
    out = None
    for n, (field, place) in enumerate(shapes):
        item = _s(url=F.col("job_url"), **place, **_either("title", "name", F.col("title")), **_either("description", "description_plain", F.expr(ABOUT)), **_either("published_at", "created_at", F.expr(DAY)), **_either("employment_type", "contract_type", kind))
        own = _ats(spark, sf_dir, "factorialhr", item, field, "acme", f"ord % 97 % 3 = {n}")
        out = own if out is None else out.unionByName(own)
    return out


HINT = "CASE page_id % 5 WHEN 0 THEN 'https://boards.greenhouse.io/acme' WHEN 1 THEN 'https://Acme.WD5.myworkdayjobs.com/en-US/Careers' WHEN 2 THEN 'https://jobs.lever.co/acme-co' WHEN 3 THEN 'https://acme.bamboohr.com/x' ELSE '' END"


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'workday' WHEN 2 THEN 'lever' WHEN 3 THEN 'bamboohr' END AS system, CASE page_id % 5 WHEN 0 THEN 'acme' WHEN 1 THEN 'acme|wd5|Careers' WHEN 2 THEN 'acme-co' WHEN 3 THEN 'acme' END AS token FROM pages")
def detect_ats(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ats.detect(F.concat("html", F.expr(HINT))).alias("d"))
    return p.select("page_id", "d.system", "d.token")


@query("SELECT page_id, concat('Role ', page_id) AS title, 'Acme' AS company, CASE WHEN page_id % 3 = 0 THEN 'Ramallah, PS' ELSE '' END AS location FROM pages WHERE page_id % 4 <> 3")
def parse_json_ld(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    own = _s(**{"@type": F.lit("JobPosting"), "title": F.concat(F.lit(" Role "), F.col("page_id").cast("string")), "hiringOrganization": _s(name=F.lit("Acme")), "url": F.col("page_id").cast("string"), "datePosted": F.when(F.col("page_id") % 4 == 3, "2023-12-01").otherwise("2024-01-19"), "jobLocation": F.when(F.col("page_id") % 3 == 0, _s(address=_s(addressLocality=F.lit("Ramallah"), addressCountry=F.lit("PS"))))})
    shaped = F.when(F.col("page_id") % 3 == 0, F.to_json(own)).when(F.col("page_id") % 3 == 1, F.to_json(F.array(own))).otherwise(F.to_json(_s(**{"@graph": F.array(own)})))
    pages = p.select("page_id", F.concat("html", F.lit('<script type="application/ld+json">'), shaped, F.lit("</script>")).alias("html"), F.lit("x").alias("url"))
    return local.json_ld(pages, W.now()).select(F.col("job_url").cast("bigint").alias("page_id"), "title", "company", "location")


@query("SELECT page_id, 'Backend role at Acme' AS title, concat('https://acme.example/', page_id) AS job_url FROM pages WHERE page_id % 3 = 0")
def parse_telegram(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    n = F.col("page_id").cast("string")
    body = F.when(F.col("page_id") % 3 == 2, "hello").otherwise(F.concat(F.lit('#1<br/>Backend role at Acme<br>We are hiring <a href="https://t.me/x">c</a> <a href="https://acme.example/'), n, F.lit('">apply</a>')))
    day = F.when(F.col("page_id") % 3 == 1, "2023-12-01T00:00:00+00:00").otherwise("2024-01-18T10:00:00+00:00")
    html = F.concat(F.lit('<div data-post="chan/'), n, F.lit('"><div class="js message_text">'), body, F.lit('</div><time datetime="'), day, F.lit('"></time></div>'))
    rows = local.telegram(p.select(n.alias("channel"), html.alias("html")), W.now())
    return rows.select(F.col("company").cast("bigint").alias("page_id"), "title", "job_url")


@query(f"""WITH own AS (SELECT page_id, concat(html, list_reduce(list_transform(range(page_id % 60), lambda k: concat('<a href="https://x.example/jobs/', k % 50, '">')), lambda a, b: concat(a, b), '')) AS html FROM pages)
SELECT page_id, CAST(least({local.MOST_LINKS}, len(list_distinct(regexp_extract_all(html, 'href="([^"]*/jobs?/[^"]+)"', 1)))) AS INT) AS links FROM own""")
def detail_links(spark, sf_dir):
    """Listings of up to 59 postings, some of them named twice."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = (F.col("page_id") % 60).cast("int")
    listed = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit('<a href="https://x.example/jobs/'), (k % 50).cast("string"), F.lit('">')))
    return p.select("page_id", F.size(local.detail_links(F.concat("html", F.array_join(listed, "")))).alias("links"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'first' ELSE 'second' END AS provider FROM nation")
def search_fallback(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    return local.first_provider(nation.where("n_nationkey % 3 = 0").withColumn("provider", F.lit("first")), nation.withColumn("provider", F.lit("second")), ["n_nationkey"])


@query(f"{J} SELECT ord, CASE WHEN length(trim(coalesce(description, ''))) >= 100 THEN description WHEN ord % 4000 % 2 = 0 THEN 'page' ELSE '[NO DESCRIPTION AVAILABLE - SCRAPING BLOCKED]' END AS description FROM jobs")
def description_backfill(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir)
    pages = jobs.select("job_url").distinct().where(F.regexp_extract("job_url", r"(\d+)$", 1).cast("int") % 2 == 0).withColumn("text", F.lit("page"))
    return local.described(jobs, pages).select("ord", "description")


#: What a search may return as a customer's name: part of it, more than it, or a few characters that others have too.
FOUND_NAME = "CASE c_custkey % 3 WHEN 0 THEN substr(c_name, 10) WHEN 1 THEN concat(upper(c_name), ' Inc') ELSE substr(c_name, 14, 5) END"


@query(f"SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a, (SELECT c_custkey, lower({FOUND_NAME}) AS y FROM customer) b WHERE contains(lower(a.c_name), b.y) OR contains(b.y, lower(a.c_name))")
def company_name_match(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    a, b = customer.select(F.col("c_custkey").alias("a"), F.col("c_name").alias("x")), customer.select(F.col("c_custkey").alias("b"), F.expr(FOUND_NAME).alias("y"))
    return careers.matched_names(a, "x", b, "y").select("a", "b")


@query(f"{J} SELECT ord, contains(y, x) OR contains(x, y) AS same, y <> '' AND (contains(y, x) OR contains(x, y)) AS told FROM (SELECT ord, lower(company) AS x, lower(coalesce(substr(title, 1, 1 + CAST(ord % 4 AS INT)), 'none')) AS y FROM jobs)")
def company_name_rows(spark, sf_dir):
    """Names that stand on one row: an empty found name matches any."""
    rows = W.jobs(spark, sf_dir).select("ord", "company", F.expr("substr(title, 1, 1 + CAST(ord % 4 AS INT))").alias("found"))
    return rows.select("ord", careers.same_company(F.col("company"), F.col("found")).alias("same"), careers.same_company(F.col("company"), F.col("found"), False).alias("told"))


#: Patterns of a large reputation table: some stand in many names, some in one, some in none.
PATTERNS = "SELECT DISTINCT CASE WHEN s_suppkey % 5 = 0 THEN substr(s_name, 14) WHEN s_suppkey % 5 = 1 THEN upper(substr(s_name, 16, 3)) ELSE substr(s_name, 6) END AS pattern, CASE s_suppkey % 3 WHEN 0 THEN 'blacklist' WHEN 1 THEN 'trusted' ELSE 'handle' END AS kind FROM {}"
NAMED = "SELECT c_custkey AS ord, CASE WHEN c_custkey % 50 > 0 THEN c_name END AS company, concat('https://jobs.example.com/', CAST(c_custkey * 7 AS STRING)) AS job_url FROM {}"


@query(f"""WITH p AS ({PATTERNS.format('supplier')}), n AS ({NAMED.format('customer')})
SELECT ord, EXISTS (SELECT 1 FROM p WHERE kind = 'blacklist' AND contains(lower(coalesce(company, '')), lower(pattern))) OR EXISTS (SELECT 1 FROM p WHERE kind = 'handle' AND contains(lower(job_url), lower(pattern))) AS pre_flagged_low_quality,
  EXISTS (SELECT 1 FROM p WHERE kind = 'trusted' AND contains(lower(coalesce(company, '')), lower(pattern))) AS pre_flagged_trusted FROM n""")
def reputation_patterns(spark, sf_dir):
    supplier, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "customer"))
    patterns = spark.sql(PATTERNS.format("{supplier}"), supplier=supplier)
    return filters.flag_by_patterns(spark.sql(NAMED.format("{customer}"), customer=customer), patterns).select("ord", "pre_flagged_low_quality", "pre_flagged_trusted")


@query(f"""WITH c AS (SELECT page_id, {HINT} AS hint, page_id % 3 = 0 AS cached, page_id % 6 = 0 AS miss, page_id % 9 = 0 AS old FROM pages)
SELECT page_id, CASE WHEN cached AND NOT old AND miss THEN 'page' WHEN cached AND NOT old THEN 'fetch' WHEN page_id % 5 IN (0, 1, 2) THEN 'fetch' WHEN page_id % 5 = 3 THEN 'none' ELSE 'page' END AS route, NOT (cached AND NOT old) AS fresh FROM c""")
def company_routes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("html", F.expr(HINT)).alias("html"))
    name = F.col("page_id").cast("string")
    own = p.select(name.alias("company"), F.concat(F.lit("https://"), name).alias("url"))
    cache = p.where("page_id % 3 = 0").select(name.alias("company"), F.when(F.col("page_id") % 6 > 0, "lever").alias("system"), F.when(F.col("page_id") % 6 > 0, "x").alias("token"), F.when(F.col("page_id") % 9 == 0, "2023-01-01").otherwise("2024-01-10").cast("timestamp").alias("ts"))
    pages = p.select(F.concat(F.lit("https://"), name).alias("url"), "html")
    return careers.routes(own, cache, pages, W.now()).select(F.col("company").cast("bigint").alias("page_id"), "route", "fresh")


@query(f"SELECT page_id, CASE WHEN length({_html_sql('html')}) >= 500 THEN 'text' ELSE 'rendered' END AS tier, CASE WHEN length({_html_sql('html')}) >= 500 THEN md5({_html_sql('html')}) WHEN page_id % 2 = 0 THEN md5('markdown') ELSE md5('') END AS text_md5 FROM pages")
def careers_tiers(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("url"), "html")
    return careers.tiers(p, p.where("url % 2 = 0").select("url", F.lit("markdown").alias("text"))).select(F.col("url").alias("page_id"), "tier", F.md5("text").alias("text_md5"))


MESSAGE = "CASE event_id % 5 WHEN 0 THEN 'HTTP 503 oops' WHEN 1 THEN 'invalid key' WHEN 2 THEN 'Request too large' WHEN 3 THEN 'error 429' ELSE NULL END"


@query("SELECT event_id, event_id % 5 IN (0, 3) AS retry, event_id % 5 = 2 AS too_large FROM events")
def error_kinds(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(MESSAGE).alias("m"))
    return e.select("event_id", careers.retryable(F.col("m")).alias("retry"), careers.too_large(F.col("m")).alias("too_large"))


@query(f"{U} SELECT user_id, CASE WHEN minimum >= 50 THEN 'rag' ELSE 'digest' END AS mode, concat('Typical of the chosen paths, unless what follows says otherwise:', chr(10), '- Backend', chr(10), chr(10), CASE WHEN is_admin THEN concat('The candidate''s own words, which weigh most:', chr(10), 'note', chr(10), chr(10)) ELSE '' END, 'D', CASE WHEN minimum >= 50 THEN concat(chr(10), chr(10), 'Past reactions to similar postings:', chr(10), 'one', chr(10), 'two') ELSE '' END) AS preferences FROM users")
def preference_context(spark, sf_dir):
    u = W.users(spark, sf_dir)
    users = u.select("user_id", F.col("minimum").alias("entries"), F.lit("D").alias("digest"), F.when(F.col("is_admin"), " note ").alias("note"), F.array(F.lit("backend"), F.lit("zzz")).alias("paths"))
    jobs = u.select("user_id", F.lit(1).alias("ord"))
    lines = jobs.select("user_id", "ord", F.explode(F.array(F.struct(F.lit(2).alias("rank"), F.lit("two").alias("line")), F.struct(F.lit(1).alias("rank"), F.lit("one").alias("line")))).alias("x")).select("user_id", "ord", "x.*")
    return preferences.context(jobs, users, lines).select("user_id", "mode", "preferences")


@query(f"{U} SELECT user_id, sha256(concat('s', user_id)) AS token_hash FROM users")
def feedback_tokens(spark, sf_dir):
    runs = W.users(spark, sf_dir).select("user_id", F.lit("r").alias("run_id"))
    made = preferences.feedback_tokens(runs, F.concat(F.lit("s"), F.col("user_id")), W.now())
    return preferences.valid_tokens(made, W.now()).select("user_id", "token_hash")


RESULT_SQL = "lower(origin) AS origin, CASE WHEN length(trim(coalesce(title, ''))) > 0 THEN trim(title) END AS title, CAST(least(100, tech_fit) AS INT) AS tech_fit"


@query(f"""{J} SELECT ord, {RESULT_SQL}, concat('told ', ord) AS ai_verdict, ord % 3 = 0 AS is_valid, true AS ai_evaluated FROM jobs WHERE ord % 2 = 0
UNION ALL SELECT ord, {RESULT_SQL}, NULL, NULL, false FROM jobs WHERE ord % 2 = 1""")
def result_rows(spark, sf_dir):
    """Evaluated and lower-ranked postings of a run."""
    v = F.struct(*[F.col("tech_fit").alias(n) for n in ("tech_fit", "experience_fit", "logistics_fit", "match_percentage")], F.concat(F.lit("told "), F.col("ord").cast("string")).alias("verdict"), (F.col("ord") % 3 == 0).alias("is_valid"), F.lit("high").alias("effort"))
    jobs = W.jobs(spark, sf_dir).withColumns({"verdict": v, "run_id": F.lit("r"), "job_url": F.col("ord").cast("string")})
    rows = state.result_rows(jobs.where("ord % 2 = 0"), "r", True).unionByName(state.result_rows(jobs.where("ord % 2 = 1"), "r", False))
    return rows.select(F.col("job_url").cast("bigint").alias("ord"), "origin", "title", "tech_fit", "ai_verdict", "is_valid", "ai_evaluated")


@query(f"{J} SELECT user_id, count(*) AS shown FROM jobs WHERE {NUMBER} IS NULL OR {NUMBER} < 0 OR {NUMBER} >= 55 GROUP BY user_id")
def displayed_matches(spark, sf_dir):
    return W.jobs(spark, sf_dir).where(ranking.shown(F.col("match_text"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("shown"))


@query(f"WITH {W.FLAGGED_SQL} SELECT ord, CAST(CASE WHEN suspicious AND {W.any_of("lower(concat(coalesce(location, ''), ' ', coalesce(company, '')))", V.INDIA_SIGNALS)} AND ord % 3 = 0 THEN least(30, tech_fit) ELSE tech_fit END AS BIGINT) AS match, suspicious AND {W.any_of("lower(concat(coalesce(location, ''), ' ', coalesce(company, '')))", V.INDIA_SIGNALS)} AND ord % 3 = 0 AS scam FROM flagged")
def scam_confirmation(spark, sf_dir):
    jobs = W.flagged(spark, sf_dir).drop("scam")
    v = F.struct(F.col("tech_fit").alias("match_percentage"), F.lit("v").alias("verdict"), F.col("suspicious"), F.lit(False).alias("scam"), F.lit(True).alias("is_valid"))
    snippets = F.when(F.col("ord") % 3 == 0, "A known fraud: they did not pay").otherwise("a scam?")
    out = jobs.select("ord", verdict.scam_checked(v, F.coalesce("location", F.lit("")), F.coalesce("company", F.lit("")), snippets).alias("v"))
    return out.select("ord", F.col("v.match_percentage").cast("bigint").alias("match"), F.col("v.scam").alias("scam"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place FROM customer ORDER BY place LIMIT 50")
def cv_cache_cap(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    kept = state.newest(c, [F.desc("c_acctbal"), F.asc("c_custkey")], V.CV_TEXTS)
    return dedup.ranked(kept, [], [F.desc("c_acctbal"), F.asc("c_custkey")], V.CV_TEXTS, "place").select("c_custkey", "place")


@query("SELECT event_id, CAST(epoch(timezone('Asia/Jerusalem', date_trunc('day', timezone('Asia/Jerusalem', timezone('UTC', ts))))) AS BIGINT) + 86400 AS budget_next, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + greatest(1, event_id % 50) * 3600 AS run_next, CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 7200 AS retry_at FROM events")
def schedule_steps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    return e.select("event_id", F.unix_timestamp(dates.next_budget_day(F.col("t"))).alias("budget_next"), F.unix_timestamp(dates.next_run(F.col("t"), F.col("event_id") % 50)).alias("run_next"), F.unix_timestamp(dates.retry(F.col("t"))).alias("retry_at"))


@query(f"{J} SELECT source, count(*) AS n FROM jobs WHERE NOT (coalesce(starts_with(source, 'ats_'), false) AND posted < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 60 DAYS) AND NOT (coalesce(starts_with(source, 'ddg_'), false) AND ord % 4000 % 3 = 0) GROUP BY 1")
def local_collection(spark, sf_dir):
    jobs = W.jobs(spark, sf_dir).withColumn("date_posted", F.date_format("posted", "yyyy-MM-dd'T'HH:mm:ss"))
    n = F.regexp_extract("job_url", r"(\d+)$", 1).cast("int")
    probes = jobs.select("job_url").distinct().select("job_url", F.when(n % 3 == 0, 404).otherwise(200).alias("status"), F.col("job_url").alias("final_url"))
    parts = [jobs.where(F.coalesce("source", F.lit("none")) == s) for s in ("ats_api", "ddg_website", "telegram", "jobs_ps", "remotive", "none")]
    return local.source_counts(local.collect(parts, probes, F.lit("1996-01-01").cast("timestamp")))


@query(f"WITH {ENTRIES}, e AS (SELECT * FROM entries WHERE feedback_type IN ('applied', 'block_company', 'other') AND trim(job_url) <> '') SELECT 'log' AS part, count(*) AS n FROM e UNION ALL SELECT 'seen', count(DISTINCT job_url) FROM e WHERE feedback_type = 'applied' UNION ALL SELECT 'blacklist', count(DISTINCT lower(company)) FROM e WHERE feedback_type = 'block_company'")
def feedback_drain(spark, sf_dir):
    log, applied, blocked = state.drained(entries(spark, sf_dir), spark.createDataFrame([], "pattern string"))
    n = lambda part, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return n("log", log).unionByName(n("seen", applied)).unionByName(n("blacklist", blocked))


def _events(spark, place):
    source = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").parquet(place)
    return source.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("user_id"), (F.col("event_id") % 400).cast("string").alias("job_url"))


#: Deliveries of a stream's input, in order of time.
DELIVERIES = 3


def _delivered(spark, sf_dir, run):
    """events arrive in DELIVERIES, one after the other; after each, run(place, stream) starts the stream anew from its checkpoint,
    so each reads what the last has left as state. Gives the folder; its input and checkpoint are removed at the end."""
    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first, last = events.select(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    number = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first or 0)) * DELIVERIES / F.lit((last or 0) - (first or 0) + 1))
    for n in range(DELIVERIES):
        events.where(F.coalesce(number, F.lit(0)) == n).write.mode("append").parquet(f"{place}/input")
        run(place, _events(spark, f"{place}/input"))
    for part in ("input", "checkpoint"):
        removed(spark, f"{place}/{part}")
    return place


def _streamed(spark, sf_dir, make, mode, schema):
    """Runs a stream over all of events into files of the shared folder, and reads them."""
    place = _delivered(spark, sf_dir, lambda at, stream: streams.written(make(stream), at, mode))
    return spark.read.schema(schema).parquet(f"{place}/rows").drop("batch")


@query("SELECT DISTINCT concat('u', CAST(user_id % 40 AS STRING)) AS user_id, CAST(event_id % 400 AS STRING) AS job_url FROM events")
def stream_unseen(spark, sf_dir):
    return _streamed(spark, sf_dir, streams.unseen, "append", "user_id string, job_url string")


@query("SELECT user_id, CAST(max(n) AS BIGINT) AS peak FROM (SELECT concat('u', CAST(user_id % 40 AS STRING)) AS user_id, count(*) OVER (PARTITION BY user_id % 40 ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1")
def stream_peaks(spark, sf_dir):
    rows = _streamed(spark, sf_dir, lambda c: streams.peaks(c, "user_id"), "update", "user_id string, peak bigint")
    # an update for each batch that a user is in
    return rows.groupBy("user_id").agg(F.max("peak").alias("peak"))


@query("""WITH RECURSIVE e AS (SELECT concat('u', CAST(user_id % 40 AS STRING)) AS user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events),
m AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT m.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = m.user_id AND e.t > m.t + 64800) AS t FROM m WHERE m.t IS NOT NULL)
SELECT user_id, t AS seconds FROM m WHERE t IS NOT NULL""")
def stream_cache_misses(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda c: streams.cache_misses(c, "user_id"), "append", "user_id string, seconds bigint")


@query("SELECT concat('u', CAST(user_id % 40 AS STRING)) AS user_id, CAST(event_id % 400 AS STRING) AS job_url, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS evaluated_at FROM events WHERE event_id % 400 < 200 GROUP BY 1, 2")
def stream_marks(spark, sf_dir):
    """Micro-batches as ticks: what each evaluates enters the seen table, and each comes twice, as after a failure."""

    def run(place, stream):
        table = streams.seen_table(spark, f"{place}/seen")

        def twice(batch, n):
            streams.mark_evaluated(batch, n, table)
            streams.mark_evaluated(batch, n, table)

        streams.ticks(stream.withColumn("evaluated", F.col("job_url").cast("int") < 200), twice, f"{place}/checkpoint").awaitTermination()

    place = _delivered(spark, sf_dir, run)
    return streams.seen_table(spark, f"{place}/seen").read().select("user_id", "job_url", F.date_format("evaluated_at", "yyyy-MM-dd HH:mm:ss").alias("evaluated_at"))


HISTORY = "user_id string, job_url string, ts timestamp"


@query("""WITH e AS (SELECT concat('u', CAST(user_id % 40 AS STRING)) AS user_id, CAST(event_id % 400 AS STRING) AS job_url, ts,
  floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 3.0::DOUBLE / (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1)) AS delivery FROM events)
SELECT user_id, job_url, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, count(*) FILTER (delivery > first) AS known, count(*) AS n
FROM (SELECT *, min(delivery) OVER (PARTITION BY user_id, job_url) AS first FROM e) GROUP BY 1, 2""")
def stream_history(spark, sf_dir):
    """A rolling history kept by micro-batches: each row is told whether the history had its posting, then enters it. The table is
    compacted after each second batch."""

    def run(place, stream):
        table = KeyedTable(spark, f"{place}/history", HISTORY, ["user_id", "job_url"], "last", "ts")
        streams.ticks(stream, lambda batch, n: streams.rolling_history(batch, n, table, f"{place}/told", every=2), f"{place}/checkpoint").awaitTermination()

    place = _delivered(spark, sf_dir, run)
    latest = KeyedTable(spark, f"{place}/history", HISTORY, ["user_id", "job_url"], "last", "ts").read()
    told = spark.read.schema(f"{HISTORY}, known boolean").parquet(f"{place}/told").groupBy("user_id", "job_url").agg(F.count_if("known").alias("known"), F.count(F.lit(1)).alias("n"))
    return latest.join(told, ["user_id", "job_url"]).select("user_id", "job_url", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("latest"), "known", "n")


@query(f"""{C} SELECT user_id, provider, model, CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS most FROM calls GROUP BY 1, 2, 3""")
def usage_table(spark, sf_dir):
    """Usage in three batches, one of them written twice and two before a compaction: sums are those of one pass."""
    place = f"{shared_dir(spark).rstrip('/')}/usage-{uuid.uuid4().hex}"
    keys = ["user_id", "provider", "model"]
    calls = W.calls(spark, sf_dir).select("ord", *keys, F.lit(1).cast("bigint").alias("requests"), F.col("tokens").cast("bigint").alias("tokens"), F.col("tokens").cast("bigint").alias("most"))
    table = KeyedTable(spark, place, "user_id string, provider string, model string, requests bigint, tokens bigint, most bigint", keys, "sum", sums=("requests", "tokens"), tops=("most",))
    for n in (0, 1, 1, 2):
        table.write(calls.where(F.col("ord") % 3 == n), n)
        if n == 1:
            table.compact()
    return table.read()


@query(f"{U} SELECT user_id, 1::BIGINT AS claims FROM users WHERE is_active")
def claimed_users(spark, sf_dir):
    """Two ticks that start at once: each active user is claimed by one of them."""
    place = f"{shared_dir(spark).rstrip('/')}/claims-{uuid.uuid4().hex}"
    active = W.users(spark, sf_dir).where("is_active").select("user_id")
    ticks = [Claims(spark, place, shares=32) for _ in range(2)]
    with ThreadPoolExecutor(len(ticks)) as pool:
        list(pool.map(lambda c: c.take(), ticks))
    return ticks[0].mine(active).unionByName(ticks[1].mine(active)).groupBy("user_id").agg(F.count(F.lit(1)).alias("claims"))


# all users of a tick in one plan


def _tick_parts(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    n = e.count()
    jobs = W.jobs(spark, sf_dir).drop("similarity")
    per_url = spark.range(4000).select(F.concat(F.lit("https://jobs.example.com/jobs/"), F.col("id").cast("string")).alias("job_url"), F.when(F.col("id") % 17 > 0, F.col("id") % n).alias("vec_id"))
    vectors_ = per_url.join(e.select("vec_id", "embedding"), "vec_id").select("job_url", "embedding")
    number = F.substring("user_id", 2, 9).cast("bigint")
    users = jobs.select("user_id").distinct().withColumn("vec_id", number)
    profiles = users.join(e.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("user_id", "vector", F.when(F.col("vec_id") % 3 == 0, "senior").otherwise("entry").alias("level"), F.when(F.col("vec_id") % 4 == 0, F.array(F.lit("backend"), F.lit("mobile"))).alias("paths"))
    # each user's history: one vector, under another address
    past = users.join(e.select((F.col("vec_id") - 100).alias("vec_id"), "embedding"), "vec_id").select("user_id", F.concat(F.lit("past-"), "user_id").alias("job_url"), "embedding")
    return jobs, vectors_, profiles, past


TICK_PATHS = f"CASE WHEN k % 4 = 0 THEN CASE WHEN {' OR '.join(matches("coalesce(title, '')", V.words(V.PATHS[p], '(?i)')) for p in ('backend', 'mobile'))} THEN 1.2 ELSE 1.0 END ELSE {ROLE_WEIGHT} END"
TICK_WEIGHT = f"CAST({REGION_WEIGHT} AS DOUBLE) * CAST({TRUST} AS DOUBLE) * CAST({TICK_PATHS} AS DOUBLE)"


@query(f"""WITH {OWN_SQL}, {W.FLAGGED_SQL}, {SEEN_SQL}, vectors AS (SELECT vec_id, embedding::DOUBLE[] AS e, count(*) OVER () AS n FROM embeddings),
fresh AS (SELECT * EXCLUDE (origin), CASE WHEN coalesce(origin, 'global') = 'local' THEN 'local' ELSE 'global' END AS origin, CAST(substr(user_id, 2) AS BIGINT) AS k FROM flagged f WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = f.user_id AND s.job_url = f.job_url)),
first_url AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY origin, user_id, job_url ORDER BY ord) = 1),
kept AS (SELECT *, {BODY('description')} AS body FROM first_url QUALIFY row_number() OVER (PARTITION BY origin, user_id, {BARE('title')}, {BARE('company')} ORDER BY ord) = 1),
passed AS (SELECT * FROM kept WHERE CASE WHEN origin = 'local' THEN NOT {CJK} ELSE {CHAIN} AND (k % 3 = 0 OR NOT coalesce({SENIOR}, false)) END),
placed AS (SELECT p.* EXCLUDE (similarity), v.e, CASE WHEN v.e IS NULL THEN 0.0 ELSE list_cosine_similarity(v.e, c.e) END AS similarity FROM passed p JOIN vectors c ON c.vec_id = p.k
  LEFT JOIN vectors v ON v.vec_id = CASE WHEN (p.ord % 4000) % 17 > 0 THEN (p.ord % 4000) % (SELECT max(n) FROM vectors) END),
novel AS (SELECT p.* FROM placed p JOIN vectors h ON h.vec_id = p.k + 100 WHERE p.e IS NULL OR list_cosine_similarity(p.e, h.e) < 0.97),
scored AS (SELECT *, similarity * {TICK_WEIGHT} AS weighted_score FROM novel WHERE NOT (e IS NOT NULL AND similarity < {V.SIMILARITY_FLOOR} AND origin <> 'local')),
top_ AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weighted_score DESC, ord) AS place FROM scored),
drawn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (place <= 55)::INT, sha256(concat('42:', coalesce(job_url, ''))), ord) AS draw FROM top_),
named AS (SELECT *, CASE WHEN place <= 55 THEN 'top' WHEN draw <= 5 THEN 'wildcard' ELSE 'lower' END AS part FROM drawn),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, part ORDER BY weighted_score DESC, ord) AS rank FROM named)
SELECT user_id, part, CAST(rank AS INT) AS rank, ord FROM ranked WHERE part <> 'lower' OR rank <= 25""")
def tick(spark, sf_dir):
    jobs, vectors_, profiles, past = _tick_parts(spark, sf_dir)
    local_ = F.coalesce("origin", F.lit("global")) == "local"
    out = run_tick(jobs.where(~local_), jobs.where(local_), vectors_, profiles, past, seen(spark, sf_dir), blacklist=W.BLACKLIST, trusted=W.TRUSTED)
    return out.select("user_id", "part", "rank", "ord")


# runs, claims and digests


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'success' END ELSE 'running' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'manual' ELSE 'scheduled' END AS run_trigger,
CASE WHEN o_orderkey % 6 = 0 THEN 'boom' END AS error, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS scraped, CASE WHEN o_orderkey % 9 = 0 THEN 'sent' END AS email_status FROM orders""")
def run_rows(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("user_id"))
    k = F.col("id")
    runs = state.started(spark.createDataFrame([], "id bigint, user_id string, status string, run_trigger string, started_at timestamp"), o.withColumn("trigger", F.when(k % 5 == 0, "manual").when(k % 5 == 1, "odd").otherwise("scheduled")), W.now())
    told = o.where(k % 3 == 0).select("id", F.when(k % 2 == 0, "failed").otherwise("success").alias("status"), (k % 7).alias("scraped"), F.when(k % 2 == 0, "boom").otherwise("").alias("error"), F.when(k % 9 == 0, "sent").alias("email_status"), F.lit(None).cast("string").alias("email_error"))
    return state.finalised(runs, told, W.now()).select("id", "status", "run_trigger", "error", "scraped", "email_status")


@query(f"""WITH {W.USERS_SQL}, t AS (SELECT user_id, is_admin, greatest(1, frequency_hours) * 3600 AS s, CAST(epoch({NOW}) AS BIGINT) AS n, CAST(epoch({NOW}) AS BIGINT) - minimum * 3600 AS a FROM users)
SELECT user_id, CAST(CASE WHEN is_admin THEN greatest(n + s, CAST(epoch(TIMESTAMP '2024-01-20 22:00:00') AS BIGINT)) WHEN a + s > n THEN a + s ELSE a + s * (floor((n - a) / s) + 1) END AS BIGINT) AS next_run FROM t""")
def run_claims(spark, sf_dir):
    u = W.users(spark, sf_dir).withColumns({"next_run_at": W.now() - F.make_dt_interval(hours=F.col("minimum").cast("int")), "trigger": F.when(F.col("is_admin"), "manual").otherwise("scheduled")})
    return state.claimed(u, W.now()).select("user_id", F.unix_timestamp("next_run_at").alias("next_run"))


@query(f"{U} SELECT user_id, CAST(CASE WHEN minimum % 4 = 0 THEN epoch({NOW}) + 7200 ELSE epoch({NOW}) + 86400 END AS BIGINT) AS next_run FROM users")
def run_retries(spark, sf_dir):
    u = W.users(spark, sf_dir)
    own = u.select("user_id", (W.now() + F.expr("INTERVAL 1 DAY")).alias("next_run_at"))
    return state.pulled_back(own, u.where("minimum % 4 = 0").select("user_id"), W.now()).select("user_id", F.unix_timestamp("next_run_at").alias("next_run"))


@query(f"{U} SELECT user_id, CASE WHEN minimum % 3 = 0 AND NOT is_admin THEN concat('likes ', cv_text) ELSE 'old' END AS candidate_preferences, CASE WHEN minimum % 3 = 0 THEN CAST(epoch({NOW}) AS BIGINT) ELSE 0 END AS digest_at FROM users WHERE trim(cv_text) <> ''")
def digest_persist(spark, sf_dir):
    u = W.users(spark, sf_dir).where("trim(cv_text) <> ''")
    old = u.select("user_id", F.lit("old").alias("candidate_preferences"), F.timestamp_seconds(F.lit(0)).alias("last_digest_at"))
    made = u.where("minimum % 3 = 0").select("user_id", F.when(~F.col("is_admin"), F.concat(F.lit("likes "), "cv_text")).otherwise(" ").alias("summary"))
    return state.digested(old, made, W.now()).select("user_id", "candidate_preferences", F.unix_timestamp("last_digest_at").alias("digest_at"))


@query(f"{J} SELECT ord FROM jobs WHERE ord % 3 = 0")
def approved_selection(spark, sf_dir):
    return state.approved(W.jobs(spark, sf_dir).withColumn("is_valid", F.when(F.col("ord") % 3 == 0, True).when(F.col("ord") % 3 == 1, False))).select("ord")


@query("SELECT a.vec_id FROM embeddings a WHERE a.vec_id % 3 = 0 AND a.label % 2 = 0")
def delivered_vectors(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("user_id"), F.col("vec_id").cast("string").alias("job_url"), "embedding")
    sent = e.where("vec_id % 3 = 0 and cast(user_id as int) % 2 = 0").select("user_id", "job_url")
    return state.delivered(e, sent.unionByName(sent)).select("vec_id")


@query("SELECT conv_id AS user_id, turn AS feedback_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3, turn) AS position FROM conversations WHERE turn % 5 <> 4")
def feedback_chronology(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat("conv_id", F.lit(":"), F.lpad(F.col("turn").cast("string"), 9, "0"))
    log = talk.select(F.col("conv_id").alias("user_id"), key.alias("feedback_id"), "turn", (F.col("turn") % 3).alias("submitted_at"))
    have = talk.where("turn % 5 <> 4").select(key.alias("feedback_id"), F.array(F.lit(1.0)).alias("embedding"))
    return state.feedback_in_order(log, have).select("user_id", F.col("turn").alias("feedback_id"), F.col("position").cast("bigint").alias("position"))


@query(f"{J} SELECT ord, md5({strip_sql(f"concat(trim(coalesce(title, '')), ' @ ', {strip_sql("coalesce(company, '')")}, CASE WHEN trim(coalesce(location, '')) <> '' THEN concat(' (', trim(location), ')') ELSE '' END, chr(10), chr(10), substr(coalesce(description, ''), 1, 1500))")}) AS retrieval, md5({strip_sql("concat(coalesce(title, ''), chr(10), chr(10), substr(coalesce(description, ''), 1, 7000))")}) AS embed FROM jobs")
def posting_texts(spark, sf_dir):
    c = F.col
    return W.jobs(spark, sf_dir).select("ord", F.md5(text.retrieval_text(c("title"), c("company"), c("location"), c("description"))).alias("retrieval"), F.md5(text.embed_text(c("title"), c("description"))).alias("embed"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 900 WHEN event_id % 4 = 1 THEN event_id % 70 ELSE 0 END AS tokens FROM events")
def token_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    k = F.col("event_id")
    body = F.when(k % 4 == 0, F.format_string('{"usage": {"total_tokens": %d}}', k % 900)).when(k % 4 == 1, F.format_string('{"usage_metadata": {"total_token_count": %d}}', k % 70)).when(k % 4 == 2, F.lit("no json"))
    return e.select("event_id", state.tokens_of(body).alias("tokens"))


@query("SELECT page_id, page_id % 3 = 0 AS only_linkedin, page_id % 3 = 0 AND page_id % 2 = 0 AS recent FROM pages")
def company_websites(spark, sf_dir):
    k = F.col("page_id")
    day = F.when(k % 2 == 0, F.lit("2024-01-18")).otherwise(F.lit("2023-11-02")).cast("timestamp")
    post = F.concat(F.lit("https://www.linkedin.com/posts/acme_x-activity-"), F.shiftleft(F.unix_timestamp(day) * 1000, 22).cast("string"), F.lit("-ab"))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.when(k % 3 == 0, post).otherwise(F.col("url")).alias("u"))
    recent = F.coalesce(dates.linkedin_posted(F.col("u")) >= W.now() - F.expr("INTERVAL 7 DAYS"), F.lit(False))
    return p.select("page_id", urls.linkedin_only(F.col("u")).alias("only_linkedin"), recent.alias("recent"))


@query(f"{J} SELECT title, company, location, job_url FROM (SELECT trim(coalesce(title, '')) AS title, {strip_sql("coalesce(company, '')")} AS company, coalesce(location, '') AS location, job_url FROM jobs) WHERE title <> ''")
def parse_extracted(spark, sf_dir):
    rows = W.jobs(spark, sf_dir)
    item = _s(title=F.col("title"), location=F.col("location"), url=F.col("job_url"), description=F.lit("d"))
    answers = rows.groupBy(F.trim("company").alias("company"), (F.col("ord") % 97).alias("g")).agg(F.concat(F.lit("Sure!\n```json\n"), F.to_json(F.struct(F.collect_list(item).alias("jobs"))), F.lit("\n```")).alias("payload"))
    return feeds.extracted(answers).select("title", "company", "location", "job_url")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ddg_linkedin' ELSE 'ddg_website' END AS source FROM pages WHERE page_id % 2 = 1 OR page_id % 4 = 0")
def parse_search_results(spark, sf_dir):
    k = F.col("page_id")
    day = F.when(k % 4 == 0, F.lit("2024-01-18")).otherwise(F.lit("2023-11-02")).cast("timestamp")
    post = F.concat(F.lit("https://www.linkedin.com/posts/acme-labs_x-activity-"), F.shiftleft(F.unix_timestamp(day) * 1000, 22).cast("string"), F.lit("-ab"))
    n = k.cast("string")
    found = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("Acme "), n).alias("company"), F.when(k % 2 == 0, "linkedin").otherwise("website").alias("mode"), n.alias("title"), F.lit("body").alias("body"), F.when(k % 2 == 0, post).otherwise(F.concat(F.lit("https://acme.example/jobs/engineer-"), n)).alias("href"))
    firms = found.select("company", F.lit("https://www.acme.example/").alias("website"), F.lit("").alias("linkedin")).distinct()
    out = local.search_results(found, firms, W.now())
    return out.select(F.substring("company", 6, 20).cast("bigint").alias("page_id"), "source")


@query("SELECT n_name AS name, n_nationkey AS size, NULL::STRING AS site FROM nation UNION ALL SELECT r_name, NULL, 'https://x' FROM region")
def company_lists(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias(" Name "), F.col("n_nationkey").alias("SIZE"))
    b = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("NAME"), F.lit("https://x").alias("Site"))
    return local.companies(a, b)


@query(rf"""WITH w AS (SELECT ord, list_filter(regexp_split_to_array(lower(coalesce(description, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM ({W.select_sql(W.JOB, 'orders')}))
SELECT ord, CASE WHEN len(w) > 0 THEN CAST(len(w) AS DOUBLE) END AS words FROM w""")
def hashed_words(spark, sf_dir):
    """The offline stand-in for a model; its counts add up to the words."""
    jobs = W.jobs(spark, sf_dir).select("ord", hooks.hashed_words(F.col("description")).alias("v"))
    return jobs.select("ord", F.when(F.col("v").isNotNull(), F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("words"))


@query(f"{J} SELECT ord, CASE WHEN length(trim(description)) > 0 AND NOT contains(description, 'Short') THEN CAST(length(description) AS DOUBLE) END AS first, CASE WHEN contains(description, 'Short') THEN 'overloaded' END AS error FROM jobs")
def embedding_hook(spark, sf_dir):
    """A model in Arrow batches that fails for some texts."""
    model = lambda texts: [hooks.ModelError("overloaded") if "Short" in t else [len(t), 1.0] for t in texts]
    made = hooks.embedded(W.jobs(spark, sf_dir), F.col("description"), model)
    return made.select("ord", F.col("embedding")[0].alias("first"), F.col("embedding_error").alias("error"))
