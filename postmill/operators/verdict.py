"""Model verdicts: parsing, normalising, caps, and the hook by which a model is called."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postmill.functions import coerce
from postmill.functions.text import has_any, scam_hits
from postmill.values import CARD_LIMITS, INDIA_SIGNALS, SCAM_WORDS

SCORES = ("tech_fit", "experience_fit", "logistics_fit", "match_percentage")
RAW = ", ".join(f"{n} string" for n in ("is_valid", "verdict", *SCORES, "compensation", "effort", "suspicious", "scam"))


def balanced_object(text: Column) -> Column:
    """The first {...} whose braces balance outside of strings; null without one. One walk over braces, quotes and
    backslashes, and the runs of characters between them."""
    start = F.instr(text, "{")
    chars = F.regexp_extract_all(F.substring(text, F.greatest(start, F.lit(1)), F.length(text)), F.lit(r'(?s)[{}"\\]|[^{}"\\]+'), F.lit(0))

    def step(s: Column, c: Column) -> Column:
        inside, escaped = s["inside"], s["escaped"]
        plain = ~inside
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        done = s["end"] > 0
        at = s["at"] + F.length(c)
        return F.struct(
            at.alias("at"),
            F.when(done, s["depth"]).otherwise(depth).alias("depth"),
            F.when((c == '"') & ~escaped, ~inside).otherwise(inside).alias("inside"),
            (inside & (c == "\\") & ~escaped).alias("escaped"),
            F.when(done, s["end"]).when(plain & (c == "}") & (depth == 0), at).otherwise(s["end"]).alias("end"),
        )

    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))
    end = F.aggregate(chars, first, step, lambda s: s["end"])
    return F.when((start > 0) & (end > 0), F.substring(text, start, end))


def unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)^\s*```[A-Za-z]*\s*", ""), r"(?s)\s*```\s*$", ""))


def parse(text: Column) -> Column:
    """The raw answer as a struct of strings: the whole text as JSON, or the first balanced object in it."""
    t = unfenced(text)
    return F.from_json(F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t).otherwise(balanced_object(t)), RAW)


def normalised(raw: Column) -> Column:
    """VERDICT of a struct of strings; null fields take their defaults."""
    return F.struct(
        coerce.flag(raw["is_valid"]).alias("is_valid"),
        coerce.text_or(raw["verdict"], "No verdict").alias("verdict"),
        *[coerce.score(raw[n]).cast("int").alias(n) for n in SCORES],
        coerce.text_or(raw["compensation"], "Not stated").alias("compensation"),
        coerce.effort(raw["effort"]).alias("effort"),
        coerce.flag(raw["suspicious"]).alias("suspicious"),
        coerce.flag(raw["scam"]).alias("scam"),
    )


def skipped(reason: Column) -> Column:
    """VERDICT of a posting that the gate left out."""
    return F.struct(
        F.lit(False).alias("is_valid"), F.concat(F.lit("Pre-screen skipped: "), reason).alias("verdict"), *[F.lit(0).alias(n) for n in SCORES], F.lit("Not stated").alias("compensation"), F.lit("unknown").alias("effort"), F.lit(False).alias("suspicious"), F.lit(False).alias("scam")
    )


def capped(verdict: Column, blacklisted: Column) -> Column:
    """Match capped for blacklisted and for suspicious postings, with a prefix that is set once."""
    limit = F.lit(CARD_LIMITS["flagged"])
    black = F.coalesce(blacklisted, F.lit(False))
    doubt = ~black & verdict["suspicious"] & (verdict["match_percentage"] > limit)
    told = verdict["verdict"]
    marked = F.exists(F.array(*[F.lit(f"[{m}]") for m in ("BLACKLISTED", "SCAM", "AI-SUSPICIOUS")]), lambda m: told.startswith(m))
    words = F.when(black & ~told.startswith("[BLACKLISTED]"), F.concat(F.lit("[BLACKLISTED] "), told)).when(doubt & ~marked, F.concat(F.lit("[AI-SUSPICIOUS] "), told)).otherwise(told)
    match = F.when(black | doubt, F.least(limit, verdict["match_percentage"])).otherwise(verdict["match_percentage"])
    return verdict.withField("match_percentage", match).withField("verdict", words)


def scam_checked(verdict: Column, location: Column, company: Column, snippets: Column) -> Column:
    """For suspicious postings of one segment, reports found on the web cap the match and set scam."""
    hit = verdict["suspicious"] & has_any(F.concat_ws(" ", location, company), INDIA_SIGNALS) & (scam_hits(snippets, SCAM_WORDS) >= 2)
    words = F.when(hit & ~verdict["verdict"].startswith("[SCAM]"), F.concat(F.lit("[SCAM] "), verdict["verdict"])).otherwise(verdict["verdict"])
    match = F.when(hit, F.least(F.lit(CARD_LIMITS["scam"]), verdict["match_percentage"])).otherwise(verdict["match_percentage"])
    return verdict.withField("match_percentage", match).withField("verdict", words).withField("scam", verdict["scam"] | hit).withField("is_valid", verdict["is_valid"] & ~hit)


def composite(verdict: Column) -> Column:
    return verdict["tech_fit"] * 0.5 + verdict["experience_fit"] * 0.3 + verdict["logistics_fit"] * 0.2


def judged(jobs: DataFrame, answer: Column) -> DataFrame:
    """jobs with the verdict of their answers; each is parsed once, in a step of its own."""
    parsed = jobs.withColumn("_raw", parse(answer))
    return parsed.withColumn("_own", normalised(F.col("_raw"))).withColumn("verdict", capped(F.col("_own"), F.col("pre_flagged_low_quality"))).drop("_raw", "_own")


def evaluate(jobs: DataFrame, model: Callable, prompt: Column) -> DataFrame:
    """jobs with verdict: gated ones are skipped, the others go to the model in Arrow batches (a pandas function from a
    series of prompts to a series of answers); its answer is parsed, normalised and capped."""
    def answers(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        some = prompts.notna()
        if some.any():
            out[some] = model(prompts[some]).to_numpy()
        return out

    # one pass: gated rows reach the function without a prompt and never the model
    ask = F.pandas_udf(answers, StringType())
    asked = judged(jobs.withColumn("_answer", ask(F.when(F.col("viable"), prompt))), F.col("_answer")).drop("_answer")
    return asked.withColumn("verdict", F.when(F.col("viable"), F.col("verdict")).otherwise(skipped(F.col("skip_reason"))))


def prompt(profile: Column) -> Column:
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    return F.concat(F.lit("Rate how the candidate fits the posting.\nCandidate:\n"), F.substring(profile, 1, 3000), F.lit("\nPosting: "), text("title"), F.lit(" at "), text("company"), F.lit(", "), text("location"), F.lit("\n"), F.substring(text("description"), 1, 5000))
