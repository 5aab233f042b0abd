"""What a prompt is told of a user's preferences, and tokens by which they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import strip
from postmill.functions.weights import known_paths, path_labels
from postmill.values import RETRIEVAL_FROM, TOKEN_DAYS


def mode(entries: Column) -> Column:
    return F.when(F.coalesce(entries, F.lit(0)) >= RETRIEVAL_FROM, "rag").otherwise("digest")


def starter(paths: Column) -> Column:
    return F.array_join(F.transform(known_paths(paths), lambda p: F.concat(F.lit("- "), path_labels(F.array(p)))), "\n")


def context(jobs: DataFrame, users: DataFrame, reactions: DataFrame) -> DataFrame:
    """jobs (user_id, ord, ...) with preferences. users: user_id, entries, digest, note, paths; reactions: user_id, ord,
    rank, line, the past entries nearest to each posting. From RETRIEVAL_FROM entries on these follow the digest; a note
    stands before both, and what is typical of the chosen paths before all."""
    lines = reactions.groupBy("user_id", "ord").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("_lines"))
    both = jobs.join(users, "user_id").join(lines, ["user_id", "ord"], "left")
    past = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    some = lambda head, body: F.when(strip(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(head), strip(body)))
    use = mode(F.col("entries")) == "rag"
    parts = [some("Typical of the chosen paths, unless what follows says otherwise:\n", starter(F.col("paths"))), some("The candidate's own words, which weigh most:\n", F.col("note")), some("", F.col("digest")), F.when(use, some("Past reactions to similar postings:\n", past))]
    return both.withColumns({"mode": mode(F.col("entries")), "preferences": F.concat_ws("\n\n", *parts)}).drop("_lines")


def feedback_tokens(runs: DataFrame, secret: Column, now: Column) -> DataFrame:
    """token_hash, user_id, run_id, expires_at: only the hash of a token is kept."""
    return runs.select(F.sha2(secret, 256).alias("token_hash"), "user_id", "run_id", (now + F.expr(f"INTERVAL {TOKEN_DAYS} DAYS")).alias("expires_at"))


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.where(F.col("expires_at") > now)
