"""Coercions of loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import strip


def score(value: Column) -> Column:
    """0 to 100 from a number, a number as text or with a percent sign; else 0. Decimals are cut off."""
    n = F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.lower(value.cast("string")) == "true", 1).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(F.least(F.greatest(n, F.lit(-1e9)), F.lit(1e9)).cast("int"), F.lit(0)))))


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("true", "yes", "1"), F.lit(False))


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(strip(value.cast("string")), F.lit("")), F.lit(default))


def optional_text(value: Column) -> Column:
    t = strip(value.cast("string"))
    return F.when((t != "") & ~F.lower(t).isin("nan", "none"), t)


def effort(value: Column) -> Column:
    e = F.lower(strip(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(e.isin("low", "medium", "high"), e).otherwise("unknown")


def origin(value: Column) -> Column:
    o = F.lower(strip(value.cast("string")))
    return F.when(o.isin("global", "local"), o)


def stored_effort(value: Column) -> Column:
    """As the results table takes it: null if it is none of the four."""
    e = F.lower(strip(value.cast("string")))
    return F.when(e.isin("low", "medium", "high", "unknown"), e)


def stored_int(value: Column) -> Column:
    """0 to 100, decimals cut off; null for what is no number."""
    n = value.cast("string").try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.least(F.greatest(n, F.lit(0.0)), F.lit(100.0)).cast("int"))


def similarity(value: Column) -> Column:
    """0 to 1 with four decimals, half to even; null and NaN stay null."""
    v = value.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), 4))


def percent(value: Column) -> Column:
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), "—").otherwise(F.concat(F.bround(v * 100, 0).cast("int").cast("string"), F.lit("%")))


def match_number(value: Column) -> Column:
    """The match as a number; null for N/A and other text."""
    return F.regexp_replace(value.cast("string"), "%$", "").try_cast("double")
