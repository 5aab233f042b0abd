"""Expressions at their edges: seniority phrases, geo locks, coercions, dates, addresses and texts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions import coerce, dates, text, urls, vectors, weights
from postmill.operators import filters, render, verdict, viability


def values(spark, rows, *columns, schema="v string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


SENIOR = ["Senior Engineer", "Sr Developer", "Software Engineer L5", "IC6 Engineer", "SDE 2", "SWE-3", "SRE", "Head of Data", "Engineer E4", "Vp Engineering"]
OTHER = ["Software Engineer", "L1 Support", "E2E Tester", "SDE", "Leadership Coach", "Seniority Analyst", "G5 Engineer", "", None, "Managerial role"]


def test_senior_titles(spark):
    assert values(spark, SENIOR + OTHER, filters.senior(F.col("v"))) == [True] * 10 + [False] * 10


REQUIRES = ["requires 5 years", "5+ years", "at least 7 years of python", "8 years' experience", "6-9 years in java", "10 to 12 years", "principal engineer", "senior-level developer", "minimum 5 years", "9 years of professional work"]
FREE = ["founded 5 years ago", "2-4 years", "combined 25 years", "for the past 6 years we", "4 years of experience", "3 to 6 years", "over the last 8 years", "7 years in a row", "5 years with us", "nothing"]


def test_experience_requirements(spark):
    found = values(spark, REQUIRES + FREE, viability.senior_requirement(F.col("v")))
    assert all(found[:10]) and not any(found[10:])
    assert values(spark, ["we grew for 5-7 years ago, then 6-8 years of java"], viability.senior_requirement(F.col("v"))) == ["6-8 years"]


def test_geo_locks(spark):
    locked = ["canadian residents only", "must be based in germany", "only open to candidates in india", "role is available in germany", "remote in eu only", "apac candidates only", "uk or germany (remote)", "remote — uk", "türkiye citizens only"]
    free = ["we have an office in germany", "worldwide", "candidates only", "remote-first company", "canada is nice"]
    assert values(spark, locked + free, F.col("v").rlike(viability.GEO_LOCK)) == [True] * len(locked) + [False] * len(free)
    places = ["Remote in Netherlands", "Remote - Germany", "UK (Remote)", "UK or US (Remote)", "Remote", "Berlin", "Worldwide (Remote)"]
    assert values(spark, places, F.col("v").rlike(viability.PLACE_LOCK) | F.col("v").rlike(viability.PLACE_REMOTE)) == [True, True, True, True, False, False, False]


def test_regions_and_roles(spark):
    texts = ["Remote, worldwide; HQ in China", "TÜRKIYE", "Bogotá", "New Manchester", "Manchester", "Acme (p) ltd", "x(p) ltd", "  ", "Berlin and Mumbai"]
    assert values(spark, texts, weights.region(F.col("v"))) == ["heavily_deweighted", "highly_preferred", "preferred", "neutral", "preferred", "neutral", "deweighted", "neutral", "preferred"]
    assert values(spark, ["Machine Learning Software Engineer", "Full Stack Developer", "Baker", None], weights.role_tier(F.col("v"))) == ["ai", "swe", "other", "other"]


def test_coercions(spark):
    raw = ["82%", "82.5", "-5", "200", "yes", None, "true", " 7", "1e3", "99999999999999"]
    assert values(spark, raw, coerce.score(F.col("v"))) == [82, 82, 0, 100, 0, 0, 1, 7, 1, 100]
    assert values(spark, ["yes", "TRUE", "1", "no", None], coerce.flag(F.col("v"))) == [True, True, True, False, False]
    assert values(spark, ["0.12345", "2", "-1", "x", "NaN"], coerce.similarity(F.col("v"))) == [pytest.approx(0.1234, abs=1e-4), 1.0, 0.0, None, None]
    assert values(spark, [0.125, 0.005, None], coerce.percent(F.col("v")), schema="v double") == ["12%", "0%", "—"]


def test_dates(spark):
    raw = ["1700000000", "2024-01-02T03:04:05Z", "2024-01-02", "Tue, 02 Jan 2024 03:04:05 +0000", "Posted Yesterday", None, "99999999999999999"]
    got = values(spark, raw, F.date_format(dates.posted(F.col("v")), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2023-11-14 22:13:20", "2024-01-02 03:04:05", "2024-01-02 00:00:00", "2024-01-02 03:04:05", None, None, None]
    now = F.lit(datetime(2024, 1, 10, 12)).cast("timestamp")
    at = lambda h: dates.next_anchored(F.col("v").cast("timestamp"), F.lit(h), now)
    assert values(spark, ["2024-01-10 00:00:00", "2024-01-11 00:00:00", None], F.date_format(at(5), "dd HH")) == ["10 15", "11 05", "10 17"]
    assert values(spark, ["2024-01-10 11:30:00"], F.date_format(at(0), "dd HH:mm")) == ["10 12:30"]
    assert values(spark, ["x"], F.date_format(dates.linkedin_posted(F.lit("https://l.com/posts/a-activity-7397512345678901234")), "yyyy-MM")) == ["2025-11"]


def test_addresses(spark):
    job = ["https://a.com/jobs/x", "https://a.com/careers/", "https://a.com/blog/jobs/x", "https://linkedin.com/posts/a_b", "https://a.com/2019/jobs/x", "https://a.com/applepay", None, ""]
    assert values(spark, job, urls.job_like(F.col("v")), urls.specific_job_like(F.col("v"))) == [(True, True), (True, False), (False, False), (True, True), (False, False), (False, False), (False, False), (False, False)]
    assert values(spark, ["https://www.a.com:80/x", "a.com", None], urls.domain(F.col("v"))) == ["a.com:80", "", ""]


def test_texts(spark):
    pages = ["<p>a&amp;b</p><script>x<y</script>  <b>c</b>", "<style>p{}</style>", None, "a<!-- <p> -->b", "&amp;lt;"]
    assert values(spark, pages, text.html_to_text(F.col("v"))) == ["a&b c", "", "", "a b", "&lt;"]
    assert values(spark, ["A: b: c", "none", None], *text.split_wwr_title(F.col("v"))) == [("A", "b: c"), ("", "none"), ("", None)]
    assert values(spark, ["Eng (Remote) ", None, " X\t"], text.bare_title(F.col("v"))) == ["eng", "none", "x"]


def test_vectors(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0]), (None, [1.0]), ([3.0, 4.0], [3.0])]
    got = values(spark, rows, vectors.cosine(F.col("a"), F.col("b")), schema="a array<double>, b array<double>")
    assert got == [pytest.approx(1.0), 0.0, 0.0, 0.0, 0.0, pytest.approx(0.6)]


def test_verdicts(spark):
    answers = ['{"is_valid": true, "match_percentage": 90, "verdict": "ok {"}', '```json\n{"match_percentage": "77%"}\n```', 'so: {"effort": "HIGH", "verdict": "a } b"} and {more', "no json", "", "{broken", None]
    df = spark.createDataFrame([(i, a, i == 0) for i, a in enumerate(answers)], "id int, answer string, pre_flagged_low_quality boolean")
    got = {r["id"]: r["verdict"] for r in verdict.judged(df, F.col("answer")).collect()}
    assert (got[0]["match_percentage"], got[0]["verdict"], got[0]["suspicious"]) == (55, "[BLACKLISTED] ok {", False)
    assert got[1]["match_percentage"] == 77 and got[2]["effort"] == "high" and got[2]["verdict"] == "a } b"
    assert all(got[i]["verdict"] == "No verdict" and got[i]["match_percentage"] == 0 for i in (3, 4, 5, 6))


def test_badges_and_subject(spark):
    assert values(spark, ["85", "84", "70", "69", "0", "-1", "N/A", None], render.badge_color(F.col("v"))) == ["#22c55e", "#eab308", "#eab308", "#ef4444", "#ef4444", "#9ca3af", "#9ca3af", "#9ca3af"]
