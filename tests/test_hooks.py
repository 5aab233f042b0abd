"""Models that fail: rounds, kinds of errors, batches, and faults that are no model's."""

import pytest
from pyspark.sql import functions as F

from postmill.operators import hooks, state


def test_rounds_ask_only_what_is_open(spark):
    def down(prompts, attempt):
        raise hooks.ModelError("503 UNAVAILABLE")

    def small(prompts, attempt):
        assert set(prompts) <= {"short", "long text"} and (attempt == 1 or "long text" not in set(prompts))
        return ["ok " + p if len(p) < 6 and attempt > 1 else hooks.ModelError("request too large") if len(p) > 6 else None for p in prompts]

    df = spark.createDataFrame([(1, "short"), (2, "long text"), (3, None)], "i int, p string").coalesce(1)
    rows = {r["i"]: r for r in hooks.ask_in_turn(df, F.col("p"), [hooks.Model("a", down), hooks.Model("b", small, True)], most=6).collect()}
    assert rows[1]["answer"] == "ok short" and rows[1]["answer_model"] == "b" and [(a["number"], a["kind"]) for a in rows[1]["attempts"]] == [(0, "retryable"), (1, "other"), (2, "retryable"), (3, "ok")]
    assert rows[2]["answer"] is None and [(a["model"], a["kind"]) for a in rows[2]["attempts"]] == [("a", "retryable"), ("b", "too_large"), ("a", "retryable"), ("a", "retryable")]
    assert rows[3]["attempts"] == [] and rows[3]["answer"] is None


def test_faults_are_not_swallowed(spark):
    df = spark.createDataFrame([("x",)], "p string")
    for asked in (hooks.ask_in_turn(df, F.col("p"), [hooks.Model("a", lambda p, n: 1 / 0)]), hooks.embedded(df, F.col("p"), lambda t: 1 / 0), hooks.with_snippets(df, F.col("p"), lambda t: 1 / 0)):
        # Spark names the fault, or that the worker's channel was closed by it
        with pytest.raises(Exception, match="ZeroDivision|CancelledKey|Python worker"):
            asked.collect()


def test_failed_batches_have_a_reason(spark):
    def fails(texts):
        raise hooks.ModelError("quota")

    df = spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "i int, t string")
    rows = {r["i"]: r for r in hooks.embedded(df, F.col("t"), fails).collect()}
    assert [rows[i]["embedding_error"] for i in (1, 2, 3)] == ["quota", None, None] and rows[1]["embedding"] is None
    rows = {r["i"]: r for r in hooks.with_snippets(df, F.col("t"), fails).collect()}
    assert [rows[i]["snippets_error"] for i in (1, 2, 3)] == ["quota", "quota", None] and rows[1]["snippets"] == ""


def test_kinds():
    assert [hooks.kind_of(m) for m in ("HTTP 413", "Rate limit hit, reduce your message", "429", "timeout", "no")] == ["too_large", "too_large", "retryable", "retryable", "other"]


def test_sketch_of_a_hot_key(spark):
    jobs = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") % 50 > 0, "hot").otherwise("cold").alias("user_id"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e6).alias("similarity"))
    rows = {r["user_id"]: r for r in state.similarity_summary(jobs, ["user_id"], exact=False).collect()}
    exact = {r["user_id"]: r for r in state.similarity_summary(jobs, ["user_id"]).collect()}
    for k in ("hot", "cold"):
        share = jobs.where((F.col("user_id") == k) & (F.col("similarity") <= rows[k]["middle"])).count() / jobs.where(F.col("user_id") == k).count()
        assert abs(share - 0.5) <= state.SKETCH_ERROR and rows[k]["least"] == exact[k]["least"] and rows[k]["most"] == exact[k]["most"]


def test_words_are_hashed_once(spark):
    """Counts of words by hash against a plain count, and words are split in one place of the plan, in no step over places."""
    texts = [None, "", " .,", "one", "One two, ONE", " ".join(f"w{i % 700}" for i in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    words = df.select("i", F.explode(F.split(F.lower("t"), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''").select("i", F.pmod(F.xxhash64("w"), F.lit(64)).alias("p"))
    want: dict = {}
    for r in words.collect():
        want.setdefault(r["i"], [0.0] * 64)[r["p"]] += 1
    vectors = df.select("i", hooks.hashed_words(F.col("t")).alias("v"))
    assert {r["i"]: r["v"] for r in vectors.collect() if r["v"] is not None} == want and len(want) == 3
    own = spark.range(3).select(hooks.hashed_words(F.concat_ws(" ", "id", F.col("id") + 1)).alias("v"))
    assert own._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
