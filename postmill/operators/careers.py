"""Careers pages: which way each company's postings come, and the text that a model structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import html_to_text, strip
from postmill.sources.ats import SYSTEM_PARSERS, detect
from postmill.values import LOOKBACK_DAYS, RETRYABLE, TOO_LARGE, USEFUL_TEXT


def routes(companies: DataFrame, cache: DataFrame, pages: DataFrame, now: Column, fallback: bool = True) -> DataFrame:
    """companies (company, url) with system, token, fresh and route. A fresh entry of the cache (company, system, token,
    ts) decides, also where it says that there is no system; otherwise the page (url, html) is looked at. route: fetch,
    page (structure the careers page) or none."""
    valid = cache.where(F.col("ts") >= now - F.expr(f"INTERVAL {LOOKBACK_DAYS['detection']} DAYS")).select("company", F.struct("system", "token").alias("known"))
    seen = companies.join(valid, "company", "left").join(pages.select("url", "html"), "url", "left")
    found = seen.withColumn("at", F.when(F.col("known").isNotNull(), F.col("known")).otherwise(detect(F.col("html"))))
    route = F.when(F.col("at.system").isin(*SYSTEM_PARSERS), "fetch").when(F.col("at.system").isNotNull(), "none").when(F.lit(fallback), "page").otherwise("none")
    return found.select("company", "url", F.col("at.system").alias("system"), F.col("at.token").alias("token"), F.col("known").isNull().alias("fresh"), route.alias("route"))


def tiers(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """url, tier, text: the page's own text if it is long enough, else that of the rendered page (url, text)."""
    own = pages.select("url", html_to_text(F.col("html")).alias("own"))
    both = own.join(rendered.select("url", F.col("text").alias("other")), "url", "left")
    enough = F.length("own") >= USEFUL_TEXT
    return both.select("url", F.when(enough, "text").otherwise("rendered").alias("tier"), F.when(enough, F.col("own")).otherwise(F.coalesce("other", F.lit(""))).alias("text"))


def same_company(company: Column, found: Column, empty_matches: bool = True) -> Column:
    """Whether one of two names on a row contains the other, by lower case. An empty found name is in every name, so it matches
    unless empty_matches says otherwise; a null one reads "none"."""
    one, two = F.lower(F.coalesce(company, F.lit(""))), F.lower(F.coalesce(found, F.lit("none")))
    match = F.contains(two, one) | F.contains(one, two)
    return match if empty_matches else match & (two != "")


def _shuffled(df: DataFrame) -> DataFrame:
    """df, for a join that sorts both sides and never collects one on the driver."""
    return df.hint("merge")


def _grams(names: DataFrame, name: str, most: int = 3) -> DataFrame:
    """name, n, gram: the distinct sequences of n characters of each name, n from 1 to most."""
    chars = F.split(F.col(name), "")

    def of(n: int) -> Column:
        # arrays side by side, so that no character is looked up by place
        parts = [F.slice(chars, F.lit(k + 1), F.greatest(F.length(name) - (n - 1), F.lit(0))) for k in range(n)]
        grams = F.transform(F.arrays_zip(*[p.alias(f"c{k}") for k, p in enumerate(parts)]), lambda x: F.concat(*[x[f"c{k}"] for k in range(n)]))
        return F.transform(F.array_distinct(grams), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    return names.select(name, F.explode(F.flatten(F.array(*[of(n) for n in range(1, most + 1)]))).alias("_g")).select(name, "_g.n", "_g.gram")


def containing(short: DataFrame, s: str, long: DataFrame, t: str) -> DataFrame:
    """The distinct pairs (s, t) of names of short that stand in names of long; empty names take no part.

    Each name of short is looked up under its rarest sequence of three characters among the names of long (a shorter name
    under all of itself), so what names have in common, such as `the ` or ` inc`, is no key, and a name with a sequence that
    no other has meets nothing.

    A name has many sequences, and Spark plans with the size of the names' file, so it would take tables of sequences for
    small ones and collect them on the driver: joins are by shuffle, except with the lengths.
    """
    inner, outer = (df.select(F.col(c).alias(k)).where(f"{k} <> ''").distinct() for df, c, k in ((short, s, "_s"), (long, t, "_t")))
    lengths = inner.select(F.least(F.length("_s"), F.lit(3)).alias("n")).distinct()  # three rows at most
    grams = _grams(outer, "_t").join(F.broadcast(lengths), "n", "left_semi")
    frequency = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    own = _grams(inner, "_s").where("n = least(length(_s), 3)")
    told = own.join(_shuffled(frequency), "gram", "left").select("_s", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram").alias("key"))
    rarest = told.groupBy("_s").agg(F.min("key").alias("key")).where("key.df > 0").select("_s", F.col("key.gram").alias("gram"))
    return rarest.join(_shuffled(grams.select("_t", "gram")), "gram").where(F.contains("_t", F.col("_s"))).select(F.col("_s").alias(s), F.col("_t").alias(t))


def matched_names(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """Rows of left and right of whose names one contains the other, by trimmed lower case. Names are matched once each,
    however many rows have them. An empty name would be in any other and match all rows with all: such rows are left out here;
    same_company() has it for names that stand on one row."""
    one, two = strip(F.lower(F.coalesce(F.col(a), F.lit("")))), strip(F.lower(F.coalesce(F.col(b), F.lit(""))))
    left, right = left.withColumn("_a", one), right.withColumn("_b", two)
    pairs = containing(left, "_a", right, "_b").unionByName(containing(right, "_b", left, "_a").where("_a <> _b"))
    return left.join(_shuffled(pairs), "_a").join(_shuffled(right), "_b").drop("_a", "_b")


def retryable(message: Column) -> Column:
    return F.exists(F.array(*map(F.lit, RETRYABLE)), lambda m: F.contains(F.coalesce(message, F.lit("")), m))


def too_large(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, TOO_LARGE)), lambda m: F.contains(low, m))
