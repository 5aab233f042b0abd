"""Whole digests in each format."""

from pyspark.sql import functions as F

from postmill.operators import render

JOB = "user_id string, section string, rank int, match_percentage string, title string, job_url string, company string, location string, verdict string, scam boolean, pre_flagged_low_quality boolean, suspicious boolean"


def documents(spark, kind, feedback="https://example.com/f?a=1&b=2"):
    jobs = spark.createDataFrame([("u", "job", 2, "80", "B|x", "https://b", "Acme", None, "REASON: fine", False, False, False), ("u", "job", 1, "90", "A<", "https://a", "Acme", "Berlin", None, True, False, False), ("u", "lower", 1, None, "L", "https://l", "Low", "x", None, False, False, False)], JOB)
    stats = spark.createDataFrame([("u", 10, 5), ("v", 3, None)], "user_id string, scraped int, filtered int")
    link = F.lit(feedback) if feedback else None
    return {r["user_id"]: r for r in render.document(jobs, stats, ["user_id"], kind, link).collect()}


def test_html(spark):
    rows = documents(spark, "html")
    page = rows["u"]["document"]
    assert rows["u"]["n"] == 2 and rows["v"]["n"] == 0
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</body></html>") and page.count('<a href="https://example.com/f?a=1&amp;b=2">') == 2
    order = [page.index(x) for x in ("Scraped: 10, filtered to: 5, shown: 2", "<h2>Internships (0)</h2>", render.NOTHING, "<h2>Jobs (2)</h2>", "🚨 A&lt;", "B|x", "<h2>Also found (1)</h2>", ">L<")]
    assert order == sorted(order)
    empty = rows["v"]["document"]
    assert "Also found" not in empty and empty.count(render.NOTHING) == 2 and "filtered to: 0" in empty


def test_markdown_and_text(spark):
    page = documents(spark, "markdown")["u"]["document"]
    assert "[" + render.ASK + "](https://example.com/f?a=1&b=2)" in page and "### Jobs (2)\n\n| Match |" in page and "B\\|x" in page and "**REASON:** fine" in page
    plain = documents(spark, "text", None)["u"]["document"]
    assert render.ASK not in plain and "Jobs (2)\n- 90% 🚨 A< (Acme, Berlin) https://a\n" in plain
