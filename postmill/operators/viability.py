"""The gate before the model: an ordered list of rules, the first that holds gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dictionary import first_words, some_of
from postmill.functions.text import has_any, strip
from postmill.operators.filters import wants_senior
from postmill.values import GEO_PLACES, MISSING, NON_TECH_SIGNALS, SHORT, WEB_AMBIGUOUS, WEB_GLOBAL, WEB_TRIGGERS, grouped

# Numbers of years, phrasings of requirements in the order in which they are tried, other tellings of years,
# disqualifying phrases with their reasons, places and the phrasings that lock a posting to one.
YEARS = r"(?:[5-9]|1[0-9]|[2-9]\d)"
GEO = "(?:" + grouped(GEO_PLACES) + ")"
WHO = "(?:candidates?|applicants?|workers?|hires?|employees?)"
REQUIRED_YEARS = (
    rf"\b{YEARS}\+?\s*years?['’\s]*(?:of\s+)?(?:experience|exp)\b",
    rf"\b(?:minimum|min\.?|at\s+least|at\s+minimum|no\s+less\s+than)\s+(?:of\s+)?{YEARS}\+?\s*years?\b",
    rf"\b(?:requires?|require|must\s+have|needs?)\s+(?:a\s+minimum\s+of\s+)?{YEARS}\+?\s*years?\b",
    rf"\b{YEARS}\+\s*years?\b",
    rf"\b{YEARS}\+?\s*years?\s+(?:of\s+)?(?:professional|relevant|industry|hands[- ]on|commercial|proven|solid)\b",
    rf"\b{YEARS}\+?\s*years?\s+(?:of\s+(?:experience\s+)?)?(?:in|with|using|building|developing|working|programming|designing|architecting)\b",
)
SENIOR_TITLES = (r"\bsenior-level\s+(?:engineer|developer|role|position)\b", r"\bstaff\s+engineer\b", r"\bprincipal\s+engineer\b")
YEARS_RANGE = r"\b(\d{1,2})\s*(?:-|–|—|to)\s*\d{1,2}\+?\s*years?\b"
OTHER_YEARS = (
    rf"\b{YEARS}\+?\s*years?\s+(?:ago|in\s+a\s+row)\b|\bcombined\s+(?:experience\s+of\s+)?{YEARS}|\b{YEARS}\+?\s*years?\s+of\s+combined\b|\bfor\s+(?:the\s+)?(?:past|last)\s+{YEARS}\+?\s*years?\b"
    rf"|\bover\s+the\s+(?:past|last)\s+{YEARS}|\b{YEARS}\+?\s*years?\s+with\s+(?:us|our|the\s+company|the\s+team|this\s+company)\b"
)
DISQUALIFIERS = (
    (r"\bu\.?s\.?\s+citizens?\s+only\b", "US citizens only"),
    (r"\bmust\s+be\s+(?:a\s+)?u\.?s\.?\s+citizen\b", "must be a US citizen"),
    (r"\bmust\s+reside\s+in\s+the\s+(?:u\.?s\.?|united\s+states)\b", "must reside in the US"),
    (r"\bu\.?s\.?[-\s]based\s+(?:candidates?|applicants?)\s+only\b", "US-based candidates only"),
    (r"\bus\s+only\s+remote\b", "US-only remote"),
    (r"\bremote\s*[-(]\s*us\s*(?:only)?\s*[)-]?\s*$", "remote (US only) — anchored"),
    (r"\bmust\s+be\s+authorized\s+to\s+work\s+in\s+the\s+(?:u\.?s\.?|united\s+states)\b", "must be authorized to work in the US"),
    (r"\b(?:u\.?s\.?|united\s+states)\s+work\s+authorization\s+required\b", "US work authorization required"),
    (r"\bno\s+(?:visa\s+)?sponsorship\s+(?:will\s+be\s+)?(?:provided|offered|available)\b", "no visa sponsorship"),
    (r"\bunable\s+to\s+sponsor\s+(?:work\s+)?visas?\b", "unable to sponsor visas"),
    (r"\bsecurity\s+clearance\s+required\b", "security clearance required"),
    (r"\bactive\s+(?:security\s+)?clearance\b", "active clearance required"),
    (r"\b(?:ts\s*/\s*sci|top\s+secret\s*/\s*sci)\b", "TS/SCI clearance"),
    (r"\bsecret\s+clearance\b", "secret clearance"),
    (r"\bpublic\s+trust\s+clearance\b", "public trust clearance"),
)
GEO_LOCKS = (
    rf"\b{GEO}\s+(?:citizens?|residents?|nationals?)\s+only\b",
    rf"\bmust\s+(?:be\s+)?(?:a\s+|legal\s+)?(?:located|based|reside|residing|resident|citizen)\s+(?:in|of)\s+(?:the\s+)?{GEO}\b",
    rf"\bonly\s+(?:open|available|hiring)\s+(?:to|for)\s+(?:candidates?|applicants?)\s+(?:in|from|based\s+in|located\s+in|residing\s+in)\s+(?:the\s+)?{GEO}\b",
    rf"\b(?:role|position|opportunity|opening|job)\s+(?:is\s+)?(?:only\s+)?(?:open\s+to|available\s+(?:to|in|for))\s+(?:candidates?\s+in\s+)?(?:the\s+)?{GEO}\b",
    rf"\bmust\s+(?:have|hold|possess|be\s+able)\s+(?:the\s+)?(?:right|legal\s+right|authorization|work\s+permit)\s+to\s+work\s+in\s+(?:the\s+)?{GEO}\b",
    rf"\bmust\s+be\s+authorized\s+to\s+work\s+in\s+(?:the\s+)?{GEO}\b",
    rf"\b{GEO}\s+work\s+authorization\s+required\b",
    rf"\bremote(?:\s+(?:work|role|position))?\s+(?:in|within)\s+(?:the\s+)?{GEO}\s+only\b",
    rf"\bcandidates?\s+(?:must\s+)?(?:be\s+)?(?:from|based\s+in|located\s+in|residing\s+in)\s+(?:the\s+)?{GEO}\s+only\b",
    rf"\b{GEO}[-\s]based\s+(?:candidates?|applicants?|hires?|employees?)\s+only\b",
    rf"\b(?:hiring\s+)?{GEO}\s+{WHO}\s+only\b",
    rf"\b{GEO}[-\s]only\s+(?:role|position|remote|hiring)\b",
    rf"\b{GEO}\b(?:\s*(?:or|/)\s*\b{GEO}\b)*\s*\(remote\)",
    rf"\bremote\s*[-–—]\s*(?:the\s+)?{GEO}\b",
)
GEO_LOCK = "(?U)" + "|".join(GEO_LOCKS)
PLACE_LOCK = rf"(?iU)\bremote\s+(?:in|from|[-–—])\s+(?:the\s+)?{GEO}\b"
PLACE_REMOTE = rf"(?iU)\b{GEO}\b.{{0,30}}\(remote\)"


#: A word or two of which each phrasing above has one: patterns are tried only on texts that have it.
YEAR_HINTS, SENIOR_HINTS = ("year",), ("senior-level", "staff", "principal")
DISQUALIFIER_HINTS = ("citizens", "citizen", "reside", "based", "only", "remote", "authorized", "authorization", "sponsorship", "sponsor", "clearance", "clearance", "sci", "clearance", "clearance")
GEO_HINTS = ("only", "must", "open", "available", "authorization", "remote")


def _has(text: Column, hints) -> Column:
    out = F.contains(text, F.lit(hints[0]))
    for h in hints[1:]:
        out = out | F.contains(text, F.lit(h))
    return out


def _window_is_other(text: Column, at: Column, length: Column) -> Column:
    """Whether the match, with 14 characters before and 12 after, tells of other years than required ones."""
    first = F.greatest(at - 14, F.lit(1))
    return F.substring(text, first, at + length + 12 - first).rlike(OTHER_YEARS)


def senior_requirement(text: Column, lower: bool = False) -> Column:
    """The phrase by which a text asks for five years or more, or for a senior title; null if it doesn't. lower: the text is in
    lower case already."""
    t = text if lower else F.lower(text)
    ranges = F.regexp_extract_all(t, F.lit(YEARS_RANGE), F.lit(0))

    # positions of all ranges: each is sought in what follows the one before
    def walk(s: Column, m: Column) -> Column:
        rest = F.substring(t, s["at"], F.length(t))
        place = s["at"] + F.instr(rest, m) - 1
        high = F.regexp_extract(m, YEARS_RANGE, 1).cast("int") >= 5
        hit = s["found"].isNull() & high & ~_window_is_other(t, place, F.length(m))
        return F.struct((place + F.length(m)).alias("at"), F.when(hit, m).otherwise(s["found"]).alias("found"))

    ranged = F.aggregate(ranges, F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("found")), walk, lambda s: s["found"])
    some = F.regexp_substr(t, F.lit(YEARS_RANGE)).isNotNull()
    found = [F.when(some, ranged)]
    for pattern in REQUIRED_YEARS:
        match = F.regexp_substr(t, F.lit(pattern))
        # where it stands is asked only of what matches
        found.append(F.when(match.isNotNull(), F.when(~_window_is_other(t, F.regexp_instr(t, F.lit(pattern)), F.length(match)), match)))
    titles = [F.regexp_substr(t, F.lit(p)) for p in SENIOR_TITLES]
    return strip(F.coalesce(F.when(_has(t, YEAR_HINTS), F.coalesce(*found)), F.when(_has(t, SENIOR_HINTS), F.coalesce(*titles))))


#: What the rules read of a posting, each computed once.
PREPARED = ("_title", "_description", "_body", "_source", "_origin", "_place")


def _prepared() -> dict[str, Column]:
    low = lambda n: F.lower(F.coalesce(F.col(n), F.lit("")))
    values = (low("title"), low("description"), strip(low("description")), strip(low("source")), strip(low("origin")), strip(F.coalesce(F.col("location"), F.lit(""))))
    return dict(zip(PREPARED, values, strict=True))


def _reason(level: Column | None) -> Column:
    title, description, body, source, origin, place = map(F.col, PREPARED)
    missing = body.isin("", "nan", "none", "null") | (F.length(body) < MISSING)
    local = source.startswith("ddg_") | source.isin("telegram", "jobs_ps") | (origin == "local") | title.startswith("linkedin post:")
    cut = F.contains(description, F.lit("[no description")) | F.contains(description, F.lit("[description truncated"))
    out = F.when(F.coalesce(F.col("pre_flagged_low_quality"), F.lit(False)), "blacklisted by reputation list")
    for signal in NON_TECH_SIGNALS:
        out = out.when(F.contains(title, F.lit(signal)), f"non-tech role signal in title ({signal.strip()})")
    out = out.when(~(missing | local | cut) & (F.length(body) < SHORT), F.concat(F.lit("description too short ("), F.length(body).cast("string"), F.lit(" chars)")))
    wants = F.lit(False) if level is None else wants_senior(level)
    out = out.when(~wants & F.col("_phrase").isNotNull(), F.concat(F.lit("senior experience requirement in description ("), F.col("_phrase"), F.lit(")")))
    for (pattern, reason), hint in zip(DISQUALIFIERS, DISQUALIFIER_HINTS, strict=True):
        out = out.when(F.contains(description, F.lit(hint)) & description.rlike(pattern), f"hard disqualifier: {reason}")
    out = out.when(F.col("_lock").isNotNull(), F.concat(F.lit("hard disqualifier: geo-locked ("), strip(F.substring(F.col("_lock"), 1, 60)), F.lit(")")))
    return out.when(place.rlike(PLACE_LOCK) | place.rlike(PLACE_REMOTE), F.concat(F.lit("location geo-locked ("), strip(F.substring(place, 1, 60)), F.lit(")")))


def gate(jobs: DataFrame, level: Column | None = None) -> DataFrame:
    """jobs with skip_reason, why a posting is not worth a call (null if it is), and viable. Uses title, description, location, source,
    origin and pre_flagged_low_quality."""
    text = F.col("_description")
    phrase = senior_requirement(text, lower=True)
    # a lock names a place, so a text without the first word of any has none
    place = F.size(some_of(text, first_words(GEO_PLACES))) > 0
    lock = F.when(_has(text, GEO_HINTS), F.when(place, F.regexp_substr(text, F.lit(GEO_LOCK))))
    told = jobs.withColumns(_prepared()).withColumns({"_phrase": phrase, "_lock": lock}).withColumn("skip_reason", _reason(level))
    return told.drop(*PREPARED, "_phrase", "_lock").withColumn("viable", F.col("skip_reason").isNull())


def wants_web_search(text: Column) -> Column:
    return has_any(text, WEB_TRIGGERS) | (has_any(text, WEB_AMBIGUOUS) & ~has_any(text, WEB_GLOBAL))
