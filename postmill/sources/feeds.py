"""Feed payloads to postings. Each parser takes a frame with one payload per row and gives the RAW columns; payloads that
are null, empty, of another shape or broken give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import split_wwr_title, strip

# Words by which a board's industry counts as technical.
TECH_INDUSTRIES = ("tech", "engineer", "software", "data", "ai", "develop", "it ", "information")


def text(path: Column) -> Column:
    return F.coalesce(path.cast("string"), F.lit(""))


def first_of(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit(""))


def raw(df: DataFrame, title, company, location, url, description, posted, job_type=None) -> DataFrame:
    return df.select(
        title.alias("title"), company.alias("company"), location.alias("location"), url.alias("job_url"), description.alias("description"), (F.lit("") if job_type is None else job_type).alias("job_type"), posted.alias("date_posted")
    )


def items(payloads: DataFrame, schema: str, field: str | None = None, column: str = "payload") -> DataFrame:
    """One row j per element of the payload's list (the payload itself, or its field)."""
    whole = F.from_json(F.col(column), schema if field is None else f"struct<{field}:{schema}>")
    return payloads.select(F.explode(whole if field is None else whole[field]).alias("j")).where("j is not null")


def variants(payloads: DataFrame, path: str = "$", column: str = "payload") -> DataFrame:
    """The same for payloads whose fields have several types: j is a variant."""
    found = F.try_variant_get(F.try_parse_json(F.col(column)), path, "array<variant>")
    return payloads.select(F.explode(found).alias("j")).where("j is not null")


def v(path: str, kind: str = "string", column: str = "j") -> Column:
    return F.try_variant_get(F.col(column), path, kind)


def remotive(payloads: DataFrame) -> DataFrame:
    j = items(payloads, "array<struct<title:string,company_name:string,candidate_required_location:string,url:string,description:string,publication_date:string>>", "jobs")
    return raw(j, text(F.col("j.title")), text(F.col("j.company_name")), F.coalesce("j.candidate_required_location", F.lit("Remote")), text(F.col("j.url")), text(F.col("j.description")), text(F.col("j.publication_date")))


def arbeitnow(payloads: DataFrame) -> DataFrame:
    j = items(payloads, "array<struct<title:string,company_name:string,remote:boolean,url:string,description:string,created_at:string>>", "data").where("j.remote")
    return raw(j, text(F.col("j.title")), text(F.col("j.company_name")), F.lit("Remote"), text(F.col("j.url")), text(F.col("j.description")), text(F.col("j.created_at")))


def jobicy(payloads: DataFrame) -> DataFrame:
    """Postings of a named industry that is not technical are left out; without an industry they stay."""
    j = items(payloads, "array<struct<jobTitle:string,companyName:string,jobGeo:string,url:string,jobDescription:string,pubDate:string,jobIndustry:array<string>>>", "jobs")
    industry = F.lower(F.array_join(F.coalesce("j.jobIndustry", F.array().cast("array<string>")), " "))
    technical = F.exists(F.array(*map(F.lit, TECH_INDUSTRIES)), lambda k: F.contains(industry, k))
    j = j.where((industry == "") | technical)
    return raw(j, text(F.col("j.jobTitle")), text(F.col("j.companyName")), F.coalesce("j.jobGeo", F.lit("Remote")), text(F.col("j.url")), text(F.col("j.jobDescription")), text(F.col("j.pubDate")))


def remoteok(payloads: DataFrame) -> DataFrame:
    j = items(payloads, "array<struct<position:string,company:string,location:string,url:string,description:string,date:string,legal:string>>").where("j.legal is null")
    return raw(j, text(F.col("j.position")), text(F.col("j.company")), F.coalesce("j.location", F.lit("Remote")), text(F.col("j.url")), text(F.col("j.description")), text(F.col("j.date")))


def himalayas(payloads: DataFrame) -> DataFrame:
    """locationRestrictions is a list or a text."""
    j = variants(payloads, "$.jobs")
    places = F.coalesce(F.array_join(v("$.locationRestrictions", "array<string>"), ", "), v("$.locationRestrictions"))
    return raw(j, text(v("$.title")), text(v("$.companyName")), first_of(places, F.lit("Remote")), first_of(v("$.applicationLink"), v("$.guid")), first_of(v("$.description"), v("$.excerpt")), text(v("$.pubDate")))


def themuse(payloads: DataFrame) -> DataFrame:
    j = items(payloads, "array<struct<name:string,company:struct<name:string>,locations:array<struct<name:string>>,refs:struct<landing_page:string>,publication_date:string,contents:string>>", "results")
    places = F.array_join(F.filter(F.transform("j.locations", lambda x: x["name"]), lambda n: n.isNotNull() & (n != "")), ", ")
    return raw(j, text(F.col("j.name")), text(F.col("j.company.name")), first_of(places, F.lit("Remote/Unspecified")), text(F.col("j.refs.landing_page")), text(F.col("j.contents")), text(F.col("j.publication_date")))


def weworkremotely(entries: DataFrame) -> DataFrame:
    """Entries of an RSS feed (title, link, summary or description, published or pubDate), as spark.read.xml with rowTag item gives them."""
    have = lambda *names: first_of(*[F.col(n) for n in names if n in entries.columns])
    company, title = split_wwr_title(have("title"))
    return raw(entries, title, company, F.lit("Remote"), have("link"), have("summary", "description"), have("published", "pubDate"))


def read_rss(spark, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)


def extracted(answers: DataFrame, column: str = "payload", company: str = "company") -> DataFrame:
    """Postings that a model has listed in an answer: fences go, what lies between the first { and the last } is JSON, blank titles are left out."""
    t = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "```[A-Za-z]*", "")
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    cut = answers.select(F.col(company).alias("company"), F.when((first > 0) & F.contains(t, F.lit("}")) & (last > first), F.substring(t, first, last - first + 1)).alias("_cut"))
    j = cut.select("company", F.explode(F.from_json("_cut", "struct<jobs:array<struct<title:string,location:string,url:string,description:string>>>")["jobs"]).alias("j")).where(strip(F.coalesce("j.title", F.lit(""))) != "")
    return raw(j, strip(F.col("j.title")), text(F.col("company")), text(F.col("j.location")), text(F.col("j.url")), text(F.col("j.description")), F.lit(""))


FEEDS = {"remotive": remotive, "arbeitnow": arbeitnow, "jobicy": jobicy, "remoteok": remoteok, "himalayas": himalayas, "themuse": themuse}
