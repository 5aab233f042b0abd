"""Text expressions: trimming, HTML to text, titles, keys and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.values import words

#: Named entities that payloads carry; others come as numbers.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


#: Markers that are set in bold.
MARKERS = ("MATCH:", "REMOTE:", "GAP:", r"CLOSING[\s-]REASON:", "CLOSING:", "REASON:")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def unescape(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.replace(F.replace(text, F.lit("&#39;"), F.lit("'")), F.lit("&#34;"), F.lit('"'))


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles and drawings go, tags become blanks, entities their signs."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    return squeeze(unescape(F.regexp_replace(text, r"(?s)<[^>]*>", " ")))


def bare_title(title: Column) -> Column:
    """Title or company as a key: bracketed parts go, ends are trimmed, lower case; null is the word none."""
    return F.lower(strip(F.regexp_replace(F.coalesce(title, F.lit("none")), r"(?U)\s*\(.*?\)", "")))


def row_text(job: dict[str, Column] | None = None) -> Column:
    c = job or {n: F.col(n) for n in ("location", "title", "company", "description")}
    text = lambda n: F.coalesce(c[n].cast("string"), F.lit(""))
    return F.concat(text("location"), F.lit(" "), text("title"), F.lit(" "), text("company"), F.lit(" "), F.substring(text("description"), 1, 1200))


def embed_text(title: Column, description: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(description, F.lit("")), 1, 7000)))


def retrieval_text(title: Column, company: Column, location: Column, description: Column, most: int = 1500) -> Column:
    """The short text of a posting by which past feedback is looked up."""
    own = lambda c: strip(F.coalesce(c, F.lit("")))
    place = F.when(own(location) != "", F.concat(F.lit(" ("), own(location), F.lit(")"))).otherwise(F.lit(""))
    return strip(F.concat(own(title), F.lit(" @ "), own(company), place, F.lit("\n\n"), F.substring(own(description), 1, most)))


def split_wwr_title(raw: Column) -> tuple[Column, Column]:
    """Company and title of "Company: Title", cut at the first colon; without one the company is empty."""
    at = F.instr(raw, ":")
    return F.when(at > 0, strip(F.substring(raw, F.lit(1), at - 1))).otherwise(F.lit("")), F.when(at > 0, strip(F.substring(raw, at + 1, F.length(raw)))).otherwise(strip(raw))


def redact_email(email: Column) -> Column:
    """First and last character of the local part (of short ones the first), and the domain."""
    at = F.instr(email, "@")
    last = F.when(at > 3, F.substring(email, at - 1, F.lit(1))).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(F.substring(email, F.lit(1), F.least(at - 1, F.lit(1))), F.lit("***"), last, F.substring(email, at, F.length(email)))).otherwise(F.lit("<invalid>"))


def normalize_repo(repo: Column) -> Column:
    """owner/name of a repository given by its address or short form; null if nothing is left."""
    text = F.regexp_replace(strip(F.coalesce(repo, F.lit(""))), r"/+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^https?://", ""), r"^(www\.)?github\.com/", "")
    return F.nullif(F.regexp_replace(text, r"\.git$", ""), F.lit(""))


def bold_markers(verdict: Column, before: str = "<strong>", after: str = "</strong>") -> Column:
    return F.regexp_replace(verdict, "(?i)\\b(" + "|".join(MARKERS) + ")", f"{before}$1{after}")


def scam_hits(text: Column, keywords) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)))


def has_any(text: Column, signals) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, signals)), lambda k: F.contains(low, k))


def feedback_text(kind: Column, title: Column, company: Column, note: Column, location: Column | None = None) -> Column:
    """One line for a feedback entry; place and note only where there are any."""
    given = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    some = lambda before, c, after="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after)))
    parts = [F.concat(F.lit("["), given(kind, "unknown"), F.lit("]")), F.concat(given(title, "?"), F.lit(" @ "), given(company, "?"))]
    parts += [some("(", location, ")")] if location is not None else []
    return F.concat_ws(" ", *parts, some("— note: ", note))


def location_locked(title: Column, location: Column, places) -> Column:
    """A locked place in the location, and "remote" in neither location nor title."""
    where, what = F.lower(F.coalesce(location, F.lit("none"))), F.lower(F.coalesce(title, F.lit("none")))
    return where.rlike(words(places, "")) & ~F.contains(where, F.lit("remote")) & ~F.contains(what, F.lit("remote"))
