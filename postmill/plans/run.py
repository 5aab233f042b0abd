"""One plan for all users of a tick: filters, similarity, near duplicates, floor, choice and gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.dedup import drop_similar
from postmill.operators.filters import above_floor, filter_postings
from postmill.operators.ranking import attach_similarity, top_and_wildcards
from postmill.operators.viability import gate


def tick(global_jobs: DataFrame, local_jobs: DataFrame, embeddings: DataFrame, profile: Column | DataFrame, history: DataFrame, seen: DataFrame | None = None, level: str = "entry", paths: Column | None = None, blacklist=(), trusted=()) -> DataFrame:
    """Chosen postings with part, rank, skip_reason and viable. jobs: JOB columns; embeddings: job_url, embedding.

    With a profile table (user_id, vector, level, paths) all users go through one plan: jobs, seen and history have a
    user_id, and duplicates, near postings and the choice are each user's own. With one profile vector the jobs are one user's.
    """
    users = isinstance(profile, DataFrame)
    keys = ["user_id"] if users else []
    if users:
        own_users = profile.select("user_id", F.col("vector").alias("_vector"), F.col("level").alias("_level"), F.col("paths").alias("_paths"))
        global_jobs, local_jobs = (df.join(own_users, "user_id") for df in (global_jobs, local_jobs))
        level, paths, profile = F.col("_level"), F.col("_paths"), F.col("_vector")
    own = filter_postings(global_jobs.withColumn("origin", F.lit("global")), seen, False, level, blacklist, trusted)
    near = filter_postings(local_jobs.withColumn("origin", F.lit("local")), seen, True, level, blacklist, trusted)
    jobs = own.unionByName(near, allowMissingColumns=True)
    scored = attach_similarity(jobs, embeddings, profile, paths)
    fresh = drop_similar(scored, history, within=tuple(keys))
    kept = fresh.where(above_floor(F.col("embedding").isNotNull(), F.col("similarity"), F.col("origin")))
    return gate(top_and_wildcards(kept, keys), level if users else None).drop("_vector", "_level", "_paths")
