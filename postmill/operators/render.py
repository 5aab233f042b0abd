"""Digests: each posting becomes a row of HTML, Markdown or text, and a user's rows one document, ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import coerce
from postmill.functions.text import bold_markers


def escaped(text: Column) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(sign), F.lit(name))
    return t


def badge_color(match: Column) -> Column:
    p = coerce.match_number(match)
    return F.when(p >= 85, "#22c55e").when(p >= 70, "#eab308").when(p >= 0, "#ef4444").otherwise("#9ca3af")


def match_cell(match: Column) -> Column:
    p = coerce.match_number(match)
    return F.when(p.isNull() | (p < 0), "N/A").otherwise(F.concat(p.cast("int").cast("string"), F.lit("%")))


def flagged_title(title: Column, scam: Column, blacklisted: Column, suspicious: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.concat(F.when(yes(scam), "🚨 ").when(yes(blacklisted), "🚫 ").when(yes(suspicious), "⚠️ ").otherwise(""), F.coalesce(title, F.lit("")))


def _title() -> Column:
    return flagged_title(F.col("title"), F.col("scam"), F.col("pre_flagged_low_quality"), F.col("suspicious"))


def html_row() -> Column:
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    badge = F.concat(F.lit('<span style="color:'), badge_color(F.col("match_percentage")), F.lit('">'), match_cell(F.col("match_percentage")), F.lit("</span>"))
    link = F.concat(F.lit('<a href="'), escaped(F.col("job_url")), F.lit('">'), escaped(_title()), F.lit("</a>"))
    return F.concat(F.lit("<tr>"), cell(badge), cell(link), cell(escaped(F.col("company"))), cell(escaped(F.col("location"))), cell(bold_markers(escaped(F.col("verdict")))), F.lit("</tr>"))


def markdown_row() -> Column:
    bar = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), match_cell(F.col("match_percentage")), F.lit(" | ["), bar(_title()), F.lit("]("), F.coalesce("job_url", F.lit("")), F.lit(") | "), bar(F.col("company")), F.lit(" | "), bar(F.col("location")), F.lit(" | "), bold_markers(bar(F.col("verdict")), "**", "**"), F.lit(" |"))


def text_row() -> Column:
    t = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    return F.concat(F.lit("- "), match_cell(F.col("match_percentage")), F.lit(" "), _title(), F.lit(" ("), t("company"), F.lit(", "), t("location"), F.lit(") "), t("job_url"))


FORMATS = {
    "html": (html_row, "<table><tr><th>Match</th><th>Title</th><th>Company</th><th>Location</th><th>Verdict</th></tr>", "", "</table>"),
    "markdown": (markdown_row, "| Match | Title | Company | Location | Verdict |\n|---|---|---|---|---|\n", "\n", "\n"),
    "text": (text_row, "", "\n", "\n"),
}


def digest(jobs: DataFrame, keys: list[str], kind: str, rank: str = "rank") -> DataFrame:
    """keys, n, document: the rows of each key in order of rank. A digest has a few dozen rows, chosen before."""
    row, head, between, tail = FORMATS[kind]
    lines = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), row().alias("line"))))
    return jobs.groupBy(*keys).agg(lines.alias("lines")).select(*keys, F.size("lines").alias("n"), F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), between), F.lit(tail)).alias("document"))


#: Parts of a full digest in order: name, heading, and whether it is left out when empty.
SECTIONS = (("internship", "Internships", False), ("job", "Jobs", False), ("lower", "Also found", True))
NOTHING, ASK = "Nothing new today.", "Tell us which of these fit"
#: Of each format: what the document begins and ends with, and what stands before and after a heading and a line.
FRAMES = {
    "html": ('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>', "</body></html>", ("<h2>", "</h2>"), ("<p>", "</p>")),
    "markdown": ("", "", ("### ", "\n\n"), ("", "\n\n")),
    "text": ("", "", ("", "\n"), ("", "\n")),
}


def _within(ends: tuple[str, str], value: Column) -> Column:
    return F.concat(F.lit(ends[0]), value, F.lit(ends[1]))


def _link(kind: str, address: Column, words: str) -> Column:
    if kind == "html":
        return F.concat(F.lit('<a href="'), escaped(address), F.lit(f'">{words}</a>'))
    return F.concat(F.lit(f"[{words}]("), address, F.lit(")")) if kind == "markdown" else F.concat(F.lit(f"{words}: "), address)


def document(jobs: DataFrame, stats: DataFrame, keys: list[str], kind: str, feedback: Column | None = None, rank: str = "rank") -> DataFrame:
    """keys, n, document: a whole digest per row of stats (keys, scraped, filtered): what the run did, a link for feedback, the
    sections with their rows in order of rank, and the link once more. jobs have a section: internship, job or lower (rows
    below the cut, left out where there are none). n counts the first two. A digest has a few dozen rows, chosen before."""
    row, head, between, tail = FORMATS[kind]
    start, end, heading, line = FRAMES[kind]
    lines = F.sort_array(F.collect_list(F.struct(F.col("section"), F.col(rank).alias("r"), row().alias("line"))))
    per = jobs.groupBy(*keys).agg(lines.alias("lines"))
    whole = stats.join(per, keys, "left").withColumn("lines", F.coalesce("lines", F.array().cast(per.schema["lines"].dataType)))
    of = lambda name: F.transform(F.filter("lines", lambda x: x["section"] == name), lambda x: x["line"])
    shown = F.size(of("internship")) + F.size(of("job"))
    told = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    ask = F.lit("") if feedback is None else F.when(feedback.isNull(), "").otherwise(_within(line, _link(kind, feedback, ASK)))
    parts = [F.lit(start), _within(line, F.concat(F.lit("Scraped: "), told(F.col("scraped")), F.lit(", filtered to: "), told(F.col("filtered")), F.lit(", shown: "), shown.cast("string"))), ask]
    for name, title, optional in SECTIONS:
        own = of(name)
        table = F.concat(F.lit(head), F.array_join(own, between), F.lit(tail))
        body = F.concat(_within(heading, F.concat(F.lit(f"{title} ("), F.size(own).cast("string"), F.lit(")"))), F.when(F.size(own) > 0, table).otherwise(_within(line, F.lit(NOTHING))))
        parts.append(F.when(F.size(own) > 0, body).otherwise("") if optional else body)
    return whole.select(*keys, shown.alias("n"), F.concat(*parts, ask, F.lit(end)).alias("document"))


def subject(n: Column, day: Column) -> Column:
    stamp = F.date_format(day, "MMM dd")
    return F.concat(F.when(n <= 0, "No strong matches today").when(n == 1, "1 job matches your CV").otherwise(F.concat(n.cast("string"), F.lit(" jobs match your CV"))), F.lit(" ("), stamp, F.lit(")"))
