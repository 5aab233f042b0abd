"""Names within names and feedback by blocks, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.operators import careers, filters, ranking


def names(draw, n):
    parts = ["the ", "acme", "int", "inc", " ltd", "å", "ß", "x", "ab", "Data ", " "]
    return ["".join(draw.choices(parts, k=draw.randint(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_matched_names_against_all_pairs(spark, seed):
    draw = random.Random(seed)
    a, b = names(draw, 60) + [None, "", "a"], names(draw, 60) + [None, "acme", "acme"]
    left = spark.createDataFrame(list(enumerate(a)), "i int, x string").repartition(3)
    right = spark.createDataFrame(list(enumerate(b)), "j int, y string").repartition(3)
    low = lambda s: (s or "").lower().strip()
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if low(x) and low(y) and (low(x) in low(y) or low(y) in low(x)))
    assert sorted((r["i"], r["j"]) for r in careers.matched_names(left, "x", right, "y").select("i", "j").collect()) == want


def test_common_beginnings_are_no_key(spark):
    """Names that all begin alike are looked up under what sets them apart: pairs that are looked at are about those that match."""
    rows = spark.range(4000).select(F.concat(F.lit("the international "), F.md5(F.col("id").cast("string"))).alias("name"))
    pairs = careers.containing(rows.withColumnRenamed("name", "a"), "a", rows.withColumnRenamed("name", "b"), "b")
    assert pairs.count() == 4000
    told = careers._grams(rows, "name").where("n = 3").groupBy("gram").count()
    rarest = careers._grams(rows, "name").where("n = 3").join(told, "gram").groupBy("name").agg(F.min("count").alias("df")).agg(F.sum("df")).first()[0]
    assert rarest < 4000 * 40 < 4000 * 4000 / 10


def test_names_are_not_collected(spark):
    """Only the lengths go through the driver, also where the names' file is small: each name has many sequences."""
    rows = spark.range(50).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("x"))
    plan = careers.matched_names(rows, "x", rows.withColumnRenamed("x", "y"), "y")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert joins and all("LeftSemi" in line for line in joins) and "SortMergeJoin" in plan


def test_many_patterns(spark):
    jobs = spark.range(2000).select(F.col("id").alias("ord"), F.concat(F.lit("Company "), F.col("id").cast("string"), F.lit(" GmbH")).alias("company"), F.concat(F.lit("https://x.example/"), F.col("id").cast("string")).alias("job_url"))
    patterns = spark.range(100_000).select(F.concat(F.lit("company "), (F.col("id") * 7).cast("string"), F.lit(" ")).alias("pattern"), F.when(F.col("id") % 2 == 0, "blacklist").otherwise("trusted").alias("kind"))
    patterns = patterns.unionByName(spark.createDataFrame([("EXAMPLE/19", "handle"), ("", "blacklist"), (None, "trusted"), ("nowhere", "handle")], "pattern string, kind string"))
    got = {r["ord"]: (r["pre_flagged_low_quality"], r["pre_flagged_trusted"]) for r in filters.flag_by_patterns(jobs, patterns).collect()}
    assert got == {i: ((i % 7 == 0 and i // 7 % 2 == 0) or str(i).startswith("19"), i % 7 == 0 and i // 7 % 2 == 1) for i in range(2000)}


def test_literal_and_table_patterns_agree(spark):
    jobs = spark.createDataFrame([(1, "Skillfied Labs", "https://a.example/x"), (2, "Stripe", "https://spam.example"), (3, None, None), (4, "stripe SKILLFIED", "")], "ord int, company string, job_url string")
    table = spark.createDataFrame([("skillfied", "blacklist"), ("STRIPE", "trusted"), ("spam.", "handle")], "pattern string, kind string")
    look = lambda df: sorted((r["ord"], r["pre_flagged_low_quality"], r["pre_flagged_trusted"]) for r in df.collect())
    assert look(filters.flag_reputation(jobs, ["skillfied"], ["STRIPE"], ["spam."])) == look(filters.flag_by_patterns(jobs, table)) == [(1, True, False), (2, True, True), (3, False, False), (4, True, True)]


def test_an_empty_found_name_matches_any(spark):
    rows = spark.createDataFrame([("Acme", ""), ("Acme", "acme inc"), ("Acme", "me"), ("Acme", "Globex"), ("Acme", None), ("", "Globex")], "a string, b string")
    got = [tuple(r) for r in rows.select(careers.same_company(F.col("a"), F.col("b")), careers.same_company(F.col("a"), F.col("b"), False)).collect()]
    assert got == [(True, False), (True, True), (True, True), (False, False), (False, False), (True, True)]


def test_feedback_by_blocks_against_all_pairs(spark):
    draw = np.random.default_rng(2)
    vectors = {i: [float(x) for x in draw.integers(-3, 4, 5 if i % 7 else 3)] for i in range(90)}
    rows = [("ab"[i % 3 == 0], i, v if i % 11 else None) for i, v in vectors.items()] + [("a", 500, [0.0] * 5), ("a", 501, []), ("c", 502, [1.0])]
    jobs = spark.createDataFrame(rows, "label string, ord int, embedding array<double>").repartition(3)
    log = jobs.where("label <> 'c'").withColumn("entry", F.concat(F.lit("e"), F.lpad(F.col("ord").cast("string"), 3, "0"))).drop("ord")

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(sum(x * y for x, y in zip(a, b, strict=False))) / n, 9) if n else 0.0

    want = []
    for lab, o, v in rows:
        if v is not None and lab != "c":
            best = sorted((-cos(v, w), f"e{e:03d}") for l2, e, w in rows if l2 == lab and w is not None)[:4]
            want += [(lab, o, k + 1, e) for k, (_, e) in enumerate(best)]
    plan = ranking.relevant_feedback(jobs, log, ["label"], 4, block=16)
    assert sorted(tuple(r) for r in plan.select("label", "ord", "rank", "entry").collect()) == sorted(want)
    assert "FlatMapCoGroupsInArrow" in plan._jdf.queryExecution().executedPlan().toString()
