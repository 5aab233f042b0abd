"""Local sources: message channels, boards with JSON-LD, web-search results and company lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, urls
from postmill.functions.text import html_to_text, squeeze, strip
from postmill.sources.feeds import first_of, raw, text

#: Words by which a message counts as a vacancy.
HIRING = ("hiring", "vacancy", "vacancies", "job opening", "apply", "join our team", "we are looking", "internship", "وظيفة", "وظائف", "شاغر", "مطلوب", "فرصة عمل", "تدريب")
MOST_LINKS = 40


def telegram(pages: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Postings of channel previews (channel, html): one per message that is recent and looks like a vacancy. The
    title is the first line with four letters, the address the first outer link or the message itself."""
    blocks = F.slice(F.split("html", r'(?=data-post=")'), 2, 1_000_000)
    m = pages.select("channel", F.explode(blocks).alias("b"))
    body = F.regexp_extract("b", r'(?s)class="[^"]*message_text[^"]*"[^>]*>(.*?)</div>', 1)
    lines = F.split(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"), "\n")
    m = m.select("channel", F.regexp_extract("b", r'data-post="([^"]+)"', 1).alias("post"), F.regexp_extract("b", r'datetime="([^"]+)"', 1).try_cast("timestamp").alias("ts"), F.transform(lines, html_to_text).alias("lines"), F.regexp_extract_all(body, F.lit(r'href="(https?://[^"]+)"'), F.lit(1)).alias("links"))
    whole = F.array_join(F.filter("lines", lambda x: x != ""), "\n")
    title = F.coalesce(F.try_element_at(F.filter("lines", lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 4), F.lit(1)), F.lit(""))
    outer = F.filter("links", lambda x: ~F.contains(x, F.lit("t.me/")))
    hit = F.exists(F.array(*map(F.lit, HIRING)), lambda k: F.contains(F.lower(whole), k))
    m = m.where(hit & (F.col("ts").isNull() | (F.col("ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))) & (title != ""))
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))
    return raw(m, F.substring(title, 1, 200), F.col("channel"), F.lit(""), F.coalesce(F.try_element_at(outer, F.lit(1)), F.concat(F.lit("https://t.me/"), F.col("post"))), whole, stamp).withColumn("source", F.lit("telegram"))


def detail_links(html: Column, pattern: str = r'href="([^"]*/jobs?/[^"]+)"', most: int = MOST_LINKS) -> Column:
    """The first distinct detail addresses of a listing."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))), 1, most)


def json_ld(pages: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Postings (JobPosting) in the JSON-LD of pages (url, html): an object, a list, or a list below @graph. Undated and recent ones stay."""
    blocks = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    b = pages.select("url", F.explode(blocks).alias("t")).select("url", F.try_parse_json("t").alias("x")).where("x is not null")
    many = F.coalesce(F.try_variant_get("x", "$['@graph']", "array<variant>"), F.try_variant_get("x", "$", "array<variant>"), F.array(F.col("x")))
    j = b.select("url", F.explode(many).alias("j"))
    g = lambda p, k="string": F.try_variant_get("j", p, k)
    kinds = F.coalesce(g("$['@type']", "array<string>"), F.array(g("$['@type']")))
    j = j.where(F.array_contains(kinds, "JobPosting"))
    address = "$.jobLocation.address"
    listed = "$.jobLocation[0].address"
    place = F.array_join(F.filter(F.array(*[F.coalesce(g(f"{a}.{n}"), g(f"{b_}.{n}")) for a, b_ in ((address, listed),) for n in ("addressLocality", "addressRegion", "addressCountry")]), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    kind = F.lower(F.coalesce(F.array_join(g("$.employmentType", "array<string>"), " "), g("$.employmentType"), F.lit("")))
    job_type = F.when(F.contains(kind, F.lit("intern")), "internship").when(F.contains(kind, F.lit("part")), "parttime").otherwise("fulltime")
    posted = dates.posted(g("$.datePosted"))
    j = j.where((posted.isNull() | (posted >= now - F.expr(f"INTERVAL {int(days)} DAYS"))) & (squeeze(text(g("$.title"))) != ""))
    return raw(j, squeeze(text(g("$.title"))), squeeze(first_of(g("$.hiringOrganization.name"), g("$.hiringOrganization"))), place, first_of(g("$.url"), F.col("url")), html_to_text(text(g("$.description"))), text(g("$.datePosted")), job_type).withColumn("source", F.lit("jobs_ps"))


def search_results(results: DataFrame, companies: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Postings among web-search results (company, mode, title, body, href): posts whose handle fits the company and whose
    id is recent, and pages of the company's own domain that are about one posting. companies: company, website, linkedin."""
    r = results.join(companies, "company")
    posted = dates.linkedin_posted(F.col("href"))
    handle = urls.linkedin_poster(F.col("href"))
    post = (F.col("mode") == "linkedin") & F.contains("href", F.lit("linkedin.com/posts/")) & urls.handle_matches(handle, F.col("company")) & (posted >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    page = (F.col("mode") == "website") & ~urls.linkedin_only(F.col("website")) & F.contains(urls.domain(F.col("href")), urls.domain(F.col("website"))) & urls.specific_job_like(F.col("href"))
    r = r.where(post | page)
    title = F.when(F.col("mode") == "linkedin", F.concat(F.lit("LinkedIn Post: "), text(F.col("title")))).otherwise(text(F.col("title")))
    stamp = F.coalesce(F.date_format(posted, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))
    return raw(r.withColumn("source", F.concat(F.lit("ddg_"), "mode")), title, F.col("company"), F.lit(""), F.col("href"), text(F.col("body")), stamp).withColumn("source", F.when(F.col("title").startswith("LinkedIn Post:"), "ddg_linkedin").otherwise("ddg_website"))


def first_provider(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Results of the primary provider, and of the fallback for queries for which that has none."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))


def companies(*lists: DataFrame) -> DataFrame:
    """Company lists with trimmed, lower-case headers, put together."""
    out = None
    for df in lists:
        named = df.toDF(*[c.strip().lower() for c in df.columns])
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def described(jobs: DataFrame, pages: DataFrame, least: int = 100, blocked: str = "[NO DESCRIPTION AVAILABLE - SCRAPING BLOCKED]") -> DataFrame:
    """jobs whose short descriptions come from fetched pages (job_url, text); without one they say so."""
    short = F.length(strip(F.coalesce("description", F.lit("")))) < least
    return jobs.join(pages.select("job_url", F.col("text").alias("_page")), "job_url", "left").withColumn("description", F.when(short, F.coalesce(F.nullif("_page", F.lit("")), F.lit(blocked))).otherwise(F.col("description"))).drop("_page")


def source_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def collect(parts: list[DataFrame], probes: DataFrame, now: Column) -> DataFrame:
    """All local sources in one frame, without stale postings of tracking systems and dead search results."""
    from postmill.operators.filters import drop_dead, stale

    out = None
    for df in parts:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return drop_dead(out.where(~stale(F.col("source"), dates.posted(F.col("date_posted")), now)), probes)
