"""Payloads of applicant-tracking systems, and their detection in careers pages. Payload rows: company, token, payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dates import millis
from postmill.functions.text import html_to_text, unescape
from postmill.sources.feeds import first_of, raw, text, v

#: Pages that name their system, in the order in which they are tried.
WORKDAY = r"(?i)([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-zA-Z-]+/)?([a-zA-Z0-9_-]+)"
SYSTEMS = (
    ("greenhouse", r"boards\.greenhouse\.io/(?:embed/job_board\?for=)?([a-zA-Z0-9_-]+)"),
    ("lever", r"jobs\.lever\.co/([a-zA-Z0-9_-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+)"),
    ("ashby", r"ashbyhq\.com/(?:embed/)?([a-zA-Z0-9_-]+)"),
    ("workable", r"apply\.workable\.com/([a-zA-Z0-9_-]+)"),
    ("workable", r"workable\.com/(?:n/)?([a-zA-Z0-9_-]+)/jobs"),
    ("bamboohr", r"([a-zA-Z0-9_-]+)\.bamboohr\.com"),
    ("smartrecruiters", r"careers\.smartrecruiters\.com/([a-zA-Z0-9_-]+)"),
    ("factorialhr", r"([a-zA-Z0-9_-]+)\.factorialhr\.com"),
)


UNKNOWN_PLACE = "Remote/Unspecified"


def detect(html: Column) -> Column:
    """struct<system, token> of a page; null if it names none."""
    h = F.coalesce(html, F.lit(""))
    part = lambda n: F.regexp_extract(h, WORKDAY, n)
    made = lambda s, t: F.struct(F.lit(s).alias("system"), t.alias("token"))
    out = F.when(h.rlike(WORKDAY), made("workday", F.concat_ws("|", F.lower(part(1)), F.lower(part(2)), part(3))))
    for system, pattern in SYSTEMS:
        out = out.when(h.rlike("(?i)" + pattern), made(system, F.regexp_extract(h, "(?i)" + pattern, 1)))
    return out


def workday_token(token: Column) -> Column:
    """struct<tenant, cluster, site>; null unless there are three parts."""
    parts = F.split(token, r"\|", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("tenant"), parts[1].alias("cluster"), parts[2].alias("site")))


def _elements(payloads: DataFrame, *paths: str) -> DataFrame:
    """company, token, j: one row per element of the first of paths that is a list."""
    whole = F.try_parse_json("payload")
    found = F.coalesce(*[F.try_variant_get(whole, p, "array<variant>") for p in paths])
    token = F.col("token") if "token" in payloads.columns else F.lit("")
    rows = payloads.select("company", token.alias("token"), F.explode(found).alias("j"))
    return rows.where(F.coalesce(F.schema_of_variant("j").startswith("OBJECT"), F.lit(False)))


def greenhouse(payloads: DataFrame) -> DataFrame:
    j = _elements(payloads, "$.jobs")
    return raw(j, text(v("$.title")), F.col("company"), text(v("$.location.name")), text(v("$.absolute_url")), html_to_text(unescape(text(v("$.content")))), first_of(v("$.updated_at"), v("$.first_published")))


def lever(payloads: DataFrame) -> DataFrame:
    j = _elements(payloads, "$")
    return raw(j, text(v("$.text")), F.col("company"), text(v("$.categories.location")), text(v("$.hostedUrl")), first_of(v("$.descriptionPlain"), v("$.description")), millis(v("$.createdAt")))


def workable(payloads: DataFrame) -> DataFrame:
    j = _elements(payloads, "$.jobs")
    code = first_of(v("$.shortcode"), v("$.id"))
    url = F.when((F.col("token") != "") & (code != ""), F.concat(F.lit("https://apply.workable.com/"), F.col("token"), F.lit("/j/"), code, F.lit("/"))).otherwise(first_of(v("$.url"), v("$.apply_url")))
    place = F.array_join(F.filter(F.array(v("$.location.city"), v("$.location.country")), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    return raw(j, text(v("$.title")), F.col("company"), place, url, text(v("$.description")), first_of(v("$.published_on"), v("$.created_at")))


def ashby(payloads: DataFrame) -> DataFrame:
    """The location is a text or an object with a name."""
    j = _elements(payloads, "$.jobs")
    kind = F.when(F.contains(F.lower(text(v("$.employmentType"))), F.lit("intern")), "internship").otherwise("fulltime")
    return raw(j, text(v("$.title")), F.col("company"), first_of(v("$.location.name"), F.when(~F.schema_of_variant(F.coalesce(v("$.location", "variant"), F.parse_json(F.lit("null")))).startswith("OBJECT"), v("$.location"))), first_of(v("$.jobUrl"), v("$.applyUrl")), first_of(v("$.descriptionPlain"), v("$.descriptionHtml")), first_of(v("$.publishedAt"), v("$.updatedAt")), kind)


def workday(payloads: DataFrame) -> DataFrame:
    """token: tenant|cluster|site. A relative path hangs below the site."""
    j = _elements(payloads, "$.jobPostings").withColumn("w", workday_token(F.col("token")))
    base = F.concat(F.lit("https://"), F.col("w.tenant"), F.lit("."), F.col("w.cluster"), F.lit(".myworkdayjobs.com/"), F.col("w.site"))
    at = text(v("$.externalPath"))
    return raw(j, text(v("$.title")), F.col("company"), text(v("$.locationsText")), F.when(at.startswith("/"), F.concat(base, at)).otherwise(at), F.lit(""), text(v("$.postedOn")))


def factorialhr(payloads: DataFrame) -> DataFrame:
    """The payload is a list or holds one as jobs or data; the place (locations, location or city) is a list of objects or texts, an object, or a text."""
    j = _elements(payloads, "$", "$.jobs", "$.data")
    named = lambda x: first_of(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.city", "string"), F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", "string")))
    places = [v(f"$.{n}", "variant") for n in ("locations", "location", "city")]
    given = lambda x: x.isNotNull() & ~F.is_variant_null(x) & ~F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("-")).isin("", "[]")
    j = j.withColumn("p", F.coalesce(*[F.when(given(x), x) for x in places]))
    many = F.try_variant_get("p", "$", "array<variant>")
    where = F.when(many.isNotNull(), F.array_join(F.filter(F.transform(many, named), lambda x: x != ""), ", ")).when(F.col("p").isNotNull(), named(F.col("p"))).otherwise("")
    slug = first_of(v("$.slug"), v("$.id"))
    url = first_of(v("$.url"), v("$.apply_url"), F.when((slug != "") & (F.col("token") != ""), F.concat(F.lit("https://"), F.col("token"), F.lit(".factorialhr.com/job_posting/"), slug)))
    kind = F.when(F.contains(F.lower(first_of(v("$.employment_type"), v("$.contract_type"))), F.lit("intern")), "internship").otherwise("fulltime")
    return raw(j, first_of(v("$.title"), v("$.name")), F.col("company"), where, url, first_of(v("$.description"), v("$.description_plain")), first_of(v("$.published_at"), v("$.created_at")), kind)


SYSTEM_PARSERS = {"greenhouse": greenhouse, "lever": lever, "workable": workable, "ashby": ashby, "workday": workday, "factorialhr": factorialhr}


def dispatch(payloads: DataFrame) -> DataFrame:
    """RAW of payloads (system, company, token, payload) of any known system; others give no rows. Each system's rows
    go through its own parser in one plan."""
    out = None
    somewhere = F.when(F.col("location") == "", UNKNOWN_PLACE).otherwise(F.col("location"))
    for system, parse in SYSTEM_PARSERS.items():
        own = parse(payloads.where(F.col("system") == system)).withColumns({"source": F.lit("ats_api"), "location": somewhere, "job_type": F.when(F.col("job_type") == "", "fulltime").otherwise(F.col("job_type"))})
        out = own if out is None else out.unionByName(own)
    return out
