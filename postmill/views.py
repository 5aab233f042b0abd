"""Postings, calls, runs and users made from the driver's tables by expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = (
    "Senior Software Engineer", "Backend Developer (Remote)", "SRE", "Data Scientist Intern (Remote)", "Machine Learning Engineer", "Junior Java Developer", "Business Analyst Intern", "Sales Engineer Lead", "Python Developer",
    "Graduate Research Intern, Biology", "AI Engineer", "Software Engineer L5", "Full-Stack Web Developer", "Trust and Safety Specialist", "Account Executive, Software", "Embedded Systems Engineer", None, "", "Data Analyst",
    "React Native Mobile Developer", "Staff Platform Engineer", "SWE II - SDE 3", "DevOps Engineer", "Marketing Manager", "LinkedIn Post: hiring a python developer", "NLP Research Scientist", "Data Engineer (ETL)", "Software Engineer", "Internal Auditor", "后端 software engineer",
)
COMPANIES = ("Stripe", "Skillfied Labs", "SAP SE", "Acme Pvt Ltd", "Globex", "Initech (EU)", "  initech ", "Umbrella", "Webs IT Solutions", "GitLab Inc", "Hooli")
LOCATIONS = (
    "Remote", "Berlin, Germany", "Bangalore, India", "New York, NY", "Remote, India", "Ramallah, Palestine", "London, United Kingdom", "Moscow", "Worldwide", "Remote in Netherlands", "UK (Remote)", "Dubai, UAE", "Austin, TX", None, "", "São Paulo, Brazil", "Cairo",
)
DESCRIPTIONS = (
    "We are a small team that builds tools for everyone and we would love to work with you on hard problems in storage, search and ranking over the coming years and beyond.",
    "Requires 7+ years of experience with distributed systems. You will own services end to end, mentor others, write designs, and take part in on-call rotations in the team.",
    "Founded 8 years ago, our company grows. You bring curiosity and 2-4 years of practice with web services, and enjoy talking to customers about what they need from our product.",
    "Looking for 5-8 years in backend roles; strong writing; you will work across teams and time zones, and help shape how we plan, build, test and ship software at our company.",
    "Short and sweet.", "nan", None, "A brief note about a nice role at a nice company for nice people.",
    "This position is open to US citizens only because of the contracts we hold, and includes health cover, stock, and travel to our offices several times a year for planning weeks.",
    "Canadian residents only. The role includes building data pipelines, keeping them healthy, and helping analysts to get what they need from a large and growing warehouse of facts.",
    "You must be located in Germany for this role. We offer a fair salary, a calm pace, good coffee, and time to learn new things with friendly colleagues who like what they do here.",
    "Active security clearance is a must for this role and cannot be waived. You will build, run and improve systems that process large volumes of signals with tight time limits.",
    "[No description available - scraping blocked]", "Our team has a combined 25 years of doing this, and for the past 6 years we have shipped weekly. We value kindness, tests, and simple designs over clever ones, always.",
    "You will work as a staff engineer with great latitude. We are remote first, open to all locations, and meet twice a year somewhere warm to plan the next steps for the product.",
    "Eligible countries apply for this remote position; headquartered in a small town, with an office by the lake. Email us with questions and we will answer them within three days.",
)


def _case(key: str, values) -> str:
    text = " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {text} END"


K = "o_orderkey"
JOB = {
    "ord": K,
    "user_id": "concat('u', CAST(o_custkey % 40 AS STRING))",
    "title": _case(f"({K} * 7 + o_custkey)", TITLES),
    "company": _case(f"({K} * 3 + o_custkey)", COMPANIES),
    "location": _case(f"({K} * 5 + o_custkey)", LOCATIONS),
    "job_url": f"concat('https://jobs.example.com/jobs/', CAST({K} % 4000 AS STRING))",
    "description": _case(f"({K} * 11 + o_custkey)", DESCRIPTIONS),
    "job_type": f"CASE {K} % 9 WHEN 0 THEN 'internship' WHEN 1 THEN 'parttime' ELSE 'fulltime' END",
    "source": f"CASE {K} % 6 WHEN 0 THEN 'ats_api' WHEN 1 THEN 'ddg_website' WHEN 2 THEN 'telegram' WHEN 3 THEN 'jobs_ps' WHEN 4 THEN NULL ELSE 'remotive' END",
    "origin": f"CASE {K} % 5 WHEN 0 THEN 'local' WHEN 1 THEN NULL ELSE 'global' END",
    "similarity": f"CASE WHEN {K} % 13 = 0 THEN NULL ELSE (({K} * 37) % 1000) / 1000.0 END",
    "match_text": f"CASE {K} % 8 WHEN 0 THEN 'N/A' WHEN 1 THEN '82%' WHEN 2 THEN '82.5' WHEN 3 THEN '-5' WHEN 4 THEN '200' WHEN 5 THEN NULL ELSE CAST(({K} * 13) % 100 AS STRING) END",
    "tech_fit": f"({K} * 17) % 101",
    "suspicious": f"{K} % 10 = 0",
    "scam": f"{K} % 50 = 0",
    "posted": "o_orderdate",
}
CALL = {
    "ord": "event_id",
    "user_id": "concat('u', CAST(user_id % 40 AS STRING))",
    "provider": "CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END",
    "model": "event_type",
    "ok": "event_type <> 'error'",
    "tokens": "event_id % 1000",
    "ts": "ts",
}
USER = {
    "user_id": "concat('u', CAST(c_custkey AS STRING))",
    "is_active": "c_custkey % 4 <> 0",
    "frequency_hours": "c_custkey % 30",
    "is_whitelisted": "c_custkey % 5 <> 0",
    "cv_text": "CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END",
    "minimum": "c_custkey % 90",
    "is_admin": "c_custkey % 11 = 0",
}
NOW = "2024-01-20 12:34:56"
BLACKLIST = ("skillfied", "webs it", "inficore")
TRUSTED = ("stripe", "sap", "gitlab")


def select_sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores where its files give fewer splits than there are: small tables before long expressions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, columns: dict[str, str], table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")).select(*[F.expr(e).alias(n) for n, e in columns.items()])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, JOB, "orders")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from postmill.operators.filters import flag_reputation

    return flag_reputation(jobs(spark, sf_dir), BLACKLIST, TRUSTED)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, USER, "customer")


def now():
    return F.lit(NOW).cast("timestamp")


JOBS_SQL = f"jobs AS ({select_sql(JOB, 'orders')})"
CALLS_SQL = f"calls AS ({select_sql(CALL, 'events')})"
USERS_SQL = f"users AS ({select_sql(USER, 'customer')})"


def any_of(column: str, names) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in names) + ")"


FLAGGED_SQL = f"{JOBS_SQL}, flagged AS (SELECT *, {any_of('lower(company)', BLACKLIST)} AS low, {any_of('lower(company)', TRUSTED)} AS good FROM jobs)"
