"""Operators on small frames: the filter chain, similar postings, state, parsers with odd payloads, and streams."""

import json
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill import views
from postmill.operators import dedup, filters, ranking, state
from postmill.plans.run import tick
from postmill.schemas import JOB
from postmill.sources import ats, feeds, files, local
from postmill.streaming import state as streams


def postings(spark, rows):
    """rows: (title, company, location, job_url, description)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, title string, company string, location string, job_url string, description string")


FRAME = [
    ("Backend Developer", "Globex", "Remote", "u1", ""), ("Backend Developer", "Globex", "Remote", "u1", ""), ("backend developer (m/f)", " GLOBEX ", "Remote", "u2", ""), ("Python Intern", "Hooli", "Berlin", "u3", ""),
    ("Senior Engineer python", "Hooli", "Remote", "u4", ""), ("Cook", "Hooli", "Remote", "u5", ""), ("后端 python", "Hooli", "Remote", "u6", ""), ("Data Engineer", "Hooli", "Austin, TX", "u7", ""), ("Data Engineer", "Umbrella", "Remote, TX", "u8", ""),
    (None, "Hooli", "Remote", "u9", ""), ("", "Hooli", "Remote", "u10", ""), ("Python Dev", "Skillfied", "Remote", "u11", ""), ("Biology python intern", "Hooli", "Remote", "u12", ""), ("Rust Dev", "Stripe", None, None, None), ("Rust Dev II", "Stripe", "x", None, None),
    ("Java Developer", "Hooli", "Remote", "u13", "<p>" + "Wir suchen für die Firma und mit der Erfahrung. " * 6),
]


def test_filter_chain(spark):
    out = filters.filter_postings(postings(spark, FRAME), None, False, "entry", ["skillfied"], ["stripe"]).collect()
    assert sorted(r["ord"] for r in out) == [0, 3, 8, 11, 13]
    assert {r["ord"] for r in out if r["pre_flagged_low_quality"]} == {11} and {r["ord"] for r in out if r["pre_flagged_trusted"]} == {13}
    seen = spark.createDataFrame([("u1",)], "job_url string")
    again = {r["ord"] for r in filters.filter_postings(postings(spark, FRAME), seen, False, "senior").collect()}
    assert {2, 4} <= again and 0 not in again
    local_ = {r["ord"] for r in filters.filter_postings(postings(spark, FRAME), None, True).collect()}
    assert {4, 5, 7} <= local_ and 6 not in local_


def test_similar_postings(spark):
    jobs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [2.0, 0.01])], "job_url string, embedding array<double>")
    past = spark.createDataFrame([("a", [1.0, 0.0]), ("x", None)], "job_url string, embedding array<double>")
    for f in (dedup.drop_similar, dedup.drop_similar_lsh):
        assert sorted(r["job_url"] for r in f(jobs, past).collect()) == ["a", "b", "c"]
        assert f(jobs, past.limit(0)).count() == 4


def test_similar_in_blocks_against_all_pairs(spark):
    draw = np.random.default_rng(3)
    rows = [(f"u{i % 2}", f"p{i:02d}" if i % 9 else None, None if i % 13 == 0 else [*map(float, v)][: 4 + i % 3]) for i, v in enumerate(draw.integers(-2, 3, (60, 6)))]
    jobs = spark.createDataFrame(rows, "u string, job_url string, embedding array<double>").repartition(3)
    past = jobs.where("job_url is null or job_url < 'p30'").withColumn("embedding", F.col("embedding").cast("array<float>"))

    def near(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return n > 0 and sum(x * y for x, y in zip(a, b, strict=False)) / n >= 0.7 - 1e-12

    for within in ((), ("u",)):
        old = [(u, k, v) for u, k, v in rows if v is not None and (k is None or k < "p30")]
        hit = lambda u, k, v, old=old, within=within: k is not None and v is not None and any(j != k and (not within or t == u) and near(v, w) for t, j, w in old)
        want = sorted((k or "", u) for u, k, v in rows if not hit(u, k, v))
        got = sorted((r["job_url"] or "", r["u"]) for r in dedup.drop_similar(jobs, past, 0.7, block=7, within=within).collect())
        assert got == want and 10 < len(got) < 55


def test_products_of_large_blocks_are_bounded():
    """Two blocks of 20,000 have 3.2 GB of products in double; which rows are near is told from few of them at once, as in double."""
    draw = np.random.default_rng(5)
    a = draw.normal(size=(20_000, 8))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.roll(a, 1, axis=0)
    tracemalloc.start()
    near = dedup._near(a, b, np.arange(20_000, dtype=np.int32), np.roll(np.arange(20_000, dtype=np.int32), 1), 0.97)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    some = a[:300] @ b.T >= 0.97 - 1e-12
    some[np.arange(300), np.arange(1, 301)] = False
    assert near[:300].tolist() == some.any(axis=1).tolist() and 0 < near.mean() < 1
    edge = np.array([[0.6, 0.8], [1.0, 0.0]])
    assert dedup._near(edge, edge, np.arange(2), np.arange(2), 0.6).tolist() == [True, True] and not dedup._near(edge, edge, np.arange(2), np.arange(2), 0.6 + 1e-9).any()


def test_first_and_latest_with_a_hot_key(spark):
    df = spark.range(10_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(None).cast("bigint")).alias("k"))
    assert dedup.first_by(df, [F.col("k")]).count() == 3334 + 1
    assert dedup.latest(df, ["k"], "ord").where("k is null").first()["ord"] == 9998


def test_choice_per_user(spark):
    jobs = spark.range(300).select(F.col("id").alias("ord"), (F.col("id") % 2).alias("user_id"), F.col("id").cast("string").alias("job_url"), (F.col("id") % 7).cast("double").alias("weighted_score"))
    out = ranking.top_and_wildcards(jobs, ["user_id"], 10, 5, 20)
    assert {(r["user_id"], r["part"]): r["count"] for r in out.groupBy("user_id", "part").count().collect()} == {(u, p): n for u in (0, 1) for p, n in (("top", 10), ("wildcard", 5), ("lower", 20))}
    again = ranking.top_and_wildcards(jobs.repartition(7), ["user_id"], 10, 5, 20)
    assert sorted(map(tuple, out.select("ord", "part").collect())) == sorted(map(tuple, again.select("ord", "part").collect()))

    one = jobs.where("user_id = 0")
    keyed = {(r["ord"], r["part"], r["rank"]) for r in ranking.top_and_wildcards(one, ["user_id"], 10, 5, 20).collect()}
    assert {(r["ord"], r["part"], r["rank"]) for r in ranking.top_and_wildcards(one, [], 10, 5, 20).collect()} == keyed


def test_rate_limit_equals_stepping(spark):
    asked = [0.0, 0.1, 0.2, 30.0, 30.0, 31.0, 100.0]
    got = [r["start"] for r in state.rate_limited(spark.createDataFrame([(1, i, a) for i, a in enumerate(asked)], "k int, ord int, at double"), ["k"], 2.2).orderBy("ord").collect()]
    free, want = 0.0, []
    for a in asked:
        start = max(a, free)
        want.append(start)
        free = start + 2.2
    assert got == pytest.approx(want)


def test_peak_over_hour_edges(spark):
    t0 = datetime(2024, 1, 1, 0, 59, 30)
    rows = [("a", t0 + timedelta(seconds=s)) for s in (0, 10, 40, 59, 60, 61)] + [("b", t0)]
    got = {r["k"]: r["peak_rpm"] for r in state.peak_per_minute(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"]).collect()}
    assert got == {"a": 5, "b": 1}


def test_caches_and_state(spark):
    now = F.lit(datetime(2024, 1, 30)).cast("timestamp")
    t = lambda d: datetime(2024, 1, d)
    old = spark.createDataFrame([("a", t(20)), ("b", t(1)), ("c", t(25))], "hash string, ts timestamp")
    new = spark.createDataFrame([("a", t(29)), ("d", t(29))], "hash string, ts timestamp")
    assert {r["hash"]: r["ts"].day for r in state.text_cache(old, new, now, 3).collect()} == {"a": 20, "c": 25, "d": 29}
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "hash string")
    assert {r["hash"] for r in state.cached(keys, old, "hash", now, "18 DAYS").where("ts is not null").collect()} == {"a"}
    history = spark.createDataFrame([("x", "2024-01-29"), ("y", "bad"), ("z", "2024-01-02")], "job_url string, added_at string")
    assert [r["job_url"] for r in state.prune_history(history, now).collect()] == ["x"]
    issues = spark.createDataFrame([("digest 1", t(20)), ("digest 2", t(29)), ("other", t(1))], "title string, created_at timestamp")
    assert state.old_issues(issues, F.lit("2024-01-30").cast("date"), "digest").count() == 1
    tokens = ['{"usage": {"total_tokens": 5}}', '{"usage_metadata": {"total_token_count": 7}}', '{"usage": {"total_tokens": "x"}}', "broken", None]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in tokens], "r string").select(state.tokens_of(F.col("r"))).collect()] == [5, 7, 0, 0, 0]


ODD = [None, "", "{}", "[]", "null", '{"jobs": 5}', '{"jobs": [null, 3, "x"]}', "{broken", '{"data": {}}', '{"results": "x"}', '{"jobPostings": null}']


@pytest.mark.parametrize("name", sorted(feeds.FEEDS))
def test_feeds_take_odd_payloads(spark, name):
    df = spark.createDataFrame([(p,) for p in ODD], "payload string")
    assert all(r["title"] == "" for r in feeds.FEEDS[name](df).collect())


@pytest.mark.parametrize("name", sorted(ats.SYSTEM_PARSERS))
def test_systems_take_odd_payloads(spark, name):
    df = spark.createDataFrame([("Acme", "t", p) for p in ODD], "company string, token string, payload string")
    assert ats.SYSTEM_PARSERS[name](df).count() == 0


def test_polymorphic_locations(spark):
    jobs = [{"title": "a", "location": [{"city": "X", "country": "Y"}]}, {"name": "b", "location": {"name": "Z"}}, {"title": "c", "location": "W", "slug": "s"}, {"title": "d"}]
    for payload in (jobs, {"jobs": jobs}, {"data": jobs}):
        df = spark.createDataFrame([("Acme", "acme", json.dumps(payload))], "company string, token string, payload string")
        assert [(r["title"], r["location"], r["job_url"]) for r in ats.factorialhr(df).collect()] == [("a", "X", ""), ("b", "Z", ""), ("c", "W", "https://acme.factorialhr.com/job_posting/s"), ("d", "", "")]
    df = spark.createDataFrame([("Acme", "", json.dumps({"jobs": [{"title": "a", "location": {"name": "N"}, "employmentType": "Intern"}, {"title": "b", "location": "M"}]}))], "company string, token string, payload string")
    assert [(r["location"], r["job_type"]) for r in ats.ashby(df).collect()] == [("N", "internship"), ("M", "fulltime")]


def test_extracted_answers_and_rss(spark, tmp_path):
    df = spark.createDataFrame([("Acme", '```json\n{"jobs": [{"title": " A "}, {"title": ""}]}\n```'), ("B", "none"), ("C", "}{")], "company string, payload string")
    assert [(r["title"], r["company"]) for r in feeds.extracted(df).collect()] == [("A", "Acme")]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme: Dev: x</title><link>l</link><pubDate>p</pubDate></item><item><title>Plain</title></item></channel></rss>")
    rows = feeds.weworkremotely(feeds.read_rss(spark, str(tmp_path / "f.xml"))).collect()
    assert [(r["company"], r["title"], r["job_url"]) for r in rows] == [("Acme", "Dev: x", "l"), ("", "Plain", "")]


def test_search_results(spark):
    rows = [("Acme Labs", "linkedin", "We hire", "b", "https://www.linkedin.com/posts/acme_x-activity-7397512345678901234"), ("Acme Labs", "linkedin", "old", "b", "https://www.linkedin.com/posts/acme_x-activity-6000000000000000000"), ("Acme Labs", "linkedin", "other", "b", "https://www.linkedin.com/posts/zzz_x-activity-7397512345678901234"), ("Acme Labs", "website", "Dev", "b", "https://acme.com/jobs/dev-1"), ("Acme Labs", "website", "List", "b", "https://acme.com/jobs/"), ("Acme Labs", "website", "No", "b", "https://else.com/jobs/dev")]
    results = spark.createDataFrame(rows, "company string, mode string, title string, body string, href string")
    own = spark.createDataFrame([("Acme Labs", "https://www.acme.com", "acme")], "company string, website string, linkedin string")
    out = local.search_results(results, own, F.lit("2025-11-24").cast("timestamp")).collect()
    assert sorted((r["title"], r["source"]) for r in out) == [("Dev", "ddg_website"), ("LinkedIn Post: We hire", "ddg_linkedin")]
    assert local.companies(spark.createDataFrame([("a",)], "` Name ` string"), spark.createDataFrame([("b", 1)], "name string, x int")).columns == ["name", "x"]


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"_comment": "x", "blacklist": ["A", "b"], "trust": ["C"]}, indent=1))
    assert sorted(map(tuple, files.reputation(spark, str(tmp_path / "r.json")).collect())) == [("blacklist", "a"), ("blacklist", "b"), ("trust", "c")]
    (tmp_path / "h.json").write_text(json.dumps({"u1": [1.0, 2.0], "u2": {"embedding": [3.0], "added_at": "2024-01-01T00:00:00"}, "u3": {"embedding": [4.0], "added_at": "bad"}}))
    got = {r["job_url"]: (r["embedding"], r["added_at"] is not None) for r in files.history(spark, str(tmp_path / "h.json")).collect()}
    assert got == {"u1": ([1.0, 2.0], False), "u2": ([3.0], True), "u3": ([4.0], False)}


def test_tick(spark, sf):
    jobs = views.jobs(spark, sf).drop("similarity")
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = jobs.select("job_url", (F.regexp_extract("job_url", r"(\d+)$", 1).cast("bigint") % 400).alias("vec_id")).distinct().join(e.select("vec_id", "embedding"), "vec_id").drop("vec_id")
    cv = F.array(*[F.lit(float(x)) for x in e.first()["embedding"]])
    out = tick(jobs.where("ord % 2 = 0"), jobs.where("ord % 2 = 1"), vectors, cv, vectors.limit(3), blacklist=views.BLACKLIST, trusted=views.TRUSTED)
    rows = out.collect()
    assert {"part", "rank", "skip_reason", "viable"} <= set(out.columns) and rows
    assert set(x.split()[0] for x in JOB.split(", ")) - {"date_posted", "posted_ts"} <= set(out.columns) | {"posted"}
    assert all(r["similarity"] >= 0.3 or r["origin"] == "local" for r in rows if r["embedding"] is not None)


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 0, 0, 0)
    rows = [("u1", f"p{i % 4}", t0 + timedelta(seconds=7 * i)) for i in range(20)] + [("u2", "p0", t0), ("u2", "p0", t0 + timedelta(hours=19))]
    spark.createDataFrame(rows, "user_id string, job_url string, ts timestamp").repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("user_id string, job_url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _run(streams.unseen(source()), "unseen", "append")
    assert spark.table("unseen").count() == 5
    _run(streams.peaks(source(), "user_id"), "peaks", "update")
    assert {r["user_id"]: r["peak"] for r in spark.table("peaks").collect()} == {"u1": 9, "u2": 1}
    _run(streams.cache_misses(source(), "user_id"), "misses", "append")
    assert {r["user_id"]: r["count"] for r in spark.table("misses").groupBy("user_id").count().collect()} == {"u1": 1, "u2": 2}
    _run(streams.calls_per_window(source(), ["user_id"]), "windows", "append")
    assert spark.table("windows").agg(F.max("calls")).first()[0] == 9
    done = streams.seen_table(spark, str(tmp_path / "seen"))
    q = streams.ticks(source().withColumn("evaluated", F.col("job_url") != "p3"), lambda df, n: streams.mark_evaluated(df, n, done), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert done.read().where("job_url = 'p3'").count() == 0 and done.read().count() == 4
