"""Similarity, weights and the choice of what is scored and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import coerce, vectors
from postmill.functions.vectors import cosine
from postmill.functions.weights import combined_weight
from postmill.operators.dedup import ranked
from postmill.values import LOWER_RANKED, LOWER_SHOWN, SHOWN_FLOOR, TOP_N, WILDCARDS


def attach_similarity(jobs: DataFrame, embeddings: DataFrame, profile: Column, paths: Column | None = None) -> DataFrame:
    """jobs with similarity to the profile's vector and weighted_score; 0 where a posting or the profile has no vector."""
    with_vector = jobs.join(embeddings.select("job_url", "embedding"), "job_url", "left")
    out = with_vector.withColumn("similarity", cosine(F.col("embedding"), profile))
    return out.withColumn("weighted_score", F.col("similarity") * combined_weight(F.col("title"), F.col("pre_flagged_trusted"), paths))


def by_score(ties: str = "ord") -> list[Column]:
    return [F.desc("weighted_score"), F.asc(ties)]


def top_and_wildcards(jobs: DataFrame, keys: list[str], n: int = TOP_N, wildcards: int = WILDCARDS, lower: int = LOWER_RANKED, seed: int = 42) -> DataFrame:
    """part (top, wildcard, lower) and rank of the rows chosen per key: the n best; a sample of the others by a seeded
    hash of the address (the same in any partitioning); the best of what is then left."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("job_url", F.lit(""))), 256)
    if not keys:
        return _chosen_of_all(jobs, draw, n, wildcards, lower)
    w = Window.partitionBy(*keys)
    placed = jobs.withColumn("_place", F.row_number().over(w.orderBy(*by_score())))
    drawn = placed.withColumn("_draw", F.row_number().over(w.orderBy((F.col("_place") <= n).asc(), draw.asc(), F.asc("ord"))))
    part = F.when(F.col("_place") <= n, "top").when(F.col("_draw") <= wildcards, "wildcard").otherwise("lower")
    named = drawn.withColumn("part", part)
    own = Window.partitionBy(*keys, "part").orderBy(*by_score())
    return named.withColumn("rank", F.row_number().over(own)).where((F.col("part") != "lower") | (F.col("rank") <= lower)).drop("_place", "_draw")


def _chosen_of_all(jobs: DataFrame, draw: Column, n: int, wildcards: int, lower: int) -> DataFrame:
    """The same over one set of rows: each part is a limit, of which every task keeps its own best only. Whatever is
    chosen before is at most n + wildcards rows, so the next limit takes that many more and drops them."""
    best = jobs.orderBy(*by_score()).limit(n + wildcards + lower)
    first = jobs.orderBy(*by_score()).limit(n)
    top = first.select("ord")
    some = jobs.orderBy(draw.asc(), F.asc("ord")).limit(n + wildcards)
    wild = some.join(F.broadcast(top), "ord", "left_anti").orderBy(draw.asc(), F.asc("ord")).limit(wildcards)
    taken = F.broadcast(top.unionByName(wild.select("ord")))
    rest = best.join(taken, "ord", "left_anti").orderBy(*by_score()).limit(lower)
    out = first.withColumn("part", F.lit("top")).unionByName(wild.withColumn("part", F.lit("wildcard"))).unionByName(rest.withColumn("part", F.lit("lower")))
    # at most n + wildcards + lower rows are numbered
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*by_score())))


def sort_by_match(df: DataFrame) -> DataFrame:
    match, tech = F.coalesce(coerce.match_number(F.col("match_percentage")), F.lit(-1.0)), F.coalesce(F.col("tech_fit").cast("string").try_cast("double"), F.lit(0.0))
    return df.orderBy(match.desc(), tech.desc(), F.asc("ord"))


def shown(match: Column, floor: float = SHOWN_FLOOR) -> Column:
    p = coerce.match_number(match)
    return p.isNull() | (p < 0) | (p >= floor)


def meets_minimum(match: Column, minimum: Column) -> Column:
    return (F.coalesce(minimum, F.lit(0)) <= 0) | (F.coalesce(coerce.match_number(match), F.lit(0.0)) >= minimum)


def lower_ranked_shown(df: DataFrame, keys: list[str], n: int = LOWER_SHOWN) -> DataFrame:
    """Without rows that are flagged, the n best by match and then by score."""
    clear = df
    for name in ("pre_flagged_low_quality", "suspicious", "scam"):
        clear = clear.where(~F.coalesce(F.col(name), F.lit(False)))
    return ranked(clear, keys, [F.coalesce(coerce.match_number(F.col("match_percentage")), F.lit(-1.0)).desc(), F.coalesce("weighted_score", "similarity", F.lit(0.0)).desc(), F.asc("ord")], n)


def is_internship(title: Column, job_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit("intern")) | (F.lower(F.coalesce(job_type, F.lit(""))) == "internship")


def relevant_feedback(jobs: DataFrame, feedback: DataFrame, keys: list[str], k: int = 5, block: int = 2048) -> DataFrame:
    """keys, ord, entry, similarity, rank: the k entries of the same keys' feedback that are nearest to each posting, by cosine to
    nine places and then by entry. jobs: keys, ord, embedding; feedback: keys, entry, embedding; rows without a vector take
    no part. entry: numbers or text.

    Both sides of a key are dealt into blocks, however many rows it has; each two blocks are one matrix product, of which each
    posting's k best come out, and a window over those puts the blocks together.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    side = lambda df, row: df.where(F.col("embedding").isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.col(row), F.col("embedding").cast("array<double>").alias("_v"))
    left, right = side(jobs, "ord"), side(feedback, "entry")
    blocks = lambda df, name: df.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    counts = blocks(left, "_n").join(blocks(right, "_m"), names)
    every = lambda most: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(most) - 1))
    deal = lambda row, most: F.pmod(F.xxhash64(row, "_v"), F.col(most))
    met = [*names, "_a", "_b"]
    one = left.join(counts, names).select(*names, "ord", "_v", deal("ord", "_n").alias("_a"), every("_m").alias("_b"))
    two = right.join(counts, names).select(*names, "entry", "_v", every("_n").alias("_a"), deal("entry", "_m").alias("_b"))
    found = T.StructType([*left.select(*names, "ord").schema.fields, *right.select("entry").schema.fields, T.StructField("similarity", T.DoubleType())])

    def nearest(a, b):
        import numpy as np
        import pyarrow as pa

        if not a.num_rows or not b.num_rows:
            return pa.schema([*(a.schema.field(c) for c in names), a.schema.field("ord"), b.schema.field("entry"), ("similarity", pa.float64())]).empty_table()
        b = b.sort_by("entry")  # of equal ones the first is the smaller entry
        u, v = vectors.units(a.column("_v")), vectors.units(b.column("_v"))
        width = min(u.shape[1], v.shape[1])
        kept, rows = [], []
        for at in range(0, len(u), 256):
            near = np.round(u[at : at + 256, :width] @ v[:, :width].T, 9)
            if near.shape[1] > k:
                least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                row, place = np.nonzero(near >= least[:, None])
                order = np.lexsort((place, -near[row, place], row))
                row, place = row[order], place[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, place = row[first], place[first]
            else:
                row, place = (x.ravel() for x in np.indices(near.shape))
            rows.append(row + at)
            kept.append((place, near[row, place]))
        row, place, score = np.concatenate(rows), np.concatenate([p for p, _ in kept]), np.concatenate([x for _, x in kept])
        own = a.select([*names, "ord"]).take(pa.array(row))
        return own.append_column("entry", b.column("entry").take(pa.array(place))).append_column("similarity", pa.array(score))

    best = one.groupBy(*met).cogroup(two.groupBy(*met)).applyInArrow(nearest, found)
    told = best.withColumnsRenamed(dict(zip(names, keys, strict=True)))
    return ranked(told, [*keys, "ord"], [F.desc("similarity"), F.asc("entry")], k)
