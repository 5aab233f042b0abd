"""Exact top-k search by inner product.

Exhaustive term-at-a-time accumulation. Vectors are sparse rows of (term, weight); a dense vector's terms are its
positions. Queries and candidates are dealt into blocks; for each pair of blocks one task holds the candidates as
postings by term, scatters each query's weighted postings into a dense array of scores, selects the k best of the
array by partition, and a window merges the selections of all blocks.

Contract. A vector that is null or holds a null or non-finite component takes no part; an empty vector scores 0.
Vectors of different lengths are compared on the terms both have. Scores are 64-bit integers. Ties go to the smaller
id. A candidate with the query's own id is left out. Each repeated row counts as itself, as query and as candidate.
An empty table gives no rows; extra columns are left out, whatever their names. Null ids take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
LEAST_BLOCK, MOST_BLOCK = 1024, 32768
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component x as a double, as array<bigint>."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))


def finite(vector: Column) -> Column:
    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vector.isNotNull() & ~F.exists(vector, bad)


def _parts(table):
    """ids, row of each component, term of each component, weight of each component; zero weights are no terms."""
    import numpy as np

    vectors = table.column("weights").combine_chunks()
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    some = flat != 0
    return table.column("vec_id").to_numpy(), rows[some], terms[some], flat[some]


def best_of_block(candidates, queries, k: int):
    """Arrow table of FOUND: the k best candidates for each query. Both tables: vec_id, weights; queries also row."""
    import numpy as np
    import pyarrow as pa

    candidates = candidates.sort_by("vec_id")
    ids, rows, terms, weights = _parts(candidates)
    by_term = np.argsort(terms, kind="stable")
    rows, terms, weights = rows[by_term], terms[by_term], weights[by_term]
    edges = np.searchsorted(terms, np.arange((terms[-1] if len(terms) else -1) + 2))
    # a posting list that has every candidate needs no row numbers
    postings = [(None if b - a == len(ids) else rows[a:b], weights[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    query_ids, q_rows, q_terms, q_weights = _parts(queries)
    q_edges = np.searchsorted(q_rows, np.arange(len(query_ids) + 1))
    numbers = queries.column("row").to_numpy()
    out = [[], [], [], []]
    scores = np.empty(len(ids), np.int64)
    for n, own in enumerate(query_ids):
        scores[:] = 0
        for term, weight in zip(q_terms[q_edges[n] : q_edges[n + 1]], q_weights[q_edges[n] : q_edges[n + 1]], strict=True):
            if term < len(postings):
                at, posting = postings[term]
                if at is None:
                    scores += weight * posting
                else:
                    scores[at] += weight * posting
        first, after = np.searchsorted(ids, [own, own + 1]) if own < np.iinfo(np.int64).max else (np.searchsorted(ids, own), len(ids))
        place = np.r_[0:first, after : len(ids)] if after > first else slice(None)
        s, i = scores[place], ids[place]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > least)
            at = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
            s, i = s[at], i[at]
        for column, values in zip(out, (np.full(len(s), numbers[n]), np.full(len(s), own), i, s), strict=True):
            column.append(values)
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pa.table({name: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for name, x in zip(names, out, strict=True)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each of queries. Both: vec_id bigint, weights array<bigint>."""
    usable = vectors.where("vec_id is not null and weights is not null")
    asked = queries.where("vec_id is not null and weights is not null")
    n, m = usable.count(), asked.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // (4 * cores)))
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // QUERY_BLOCK))
    numbered = F.monotonically_increasing_id()
    # each candidate block meets each query block once: rows are repeated for the other side's blocks, in blocks
    left = (
        usable.select("vec_id", "weights", numbered.alias("row"))
        .withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))))
    )
    right = (
        asked.select("vec_id", "weights", numbered.alias("row"))
        .withColumn("query_block", F.pmod(F.xxhash64("row"), F.lit(query_blocks)))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    )
    keys = ["block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: best_of_block(a, b, k), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
