"""Duplicates: keep-first by keys, and near postings by vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import bare_title
from postmill.functions.vectors import cosine
from postmill.values import SAME_POSTING

#: Rows of a block of vectors, its numbers (8 bytes each where they are multiplied), and products that a task has at once (4 bytes each).
BLOCK, BLOCK_VALUES, PRODUCTS = 32_768, 2_500_000, 4_000_000
#: Blocks a side at least, as far as each has so many rows.
LEAST, LEAST_ROWS = 8, 1_024


def first_by(df: DataFrame, keys: list, order: str = "ord") -> DataFrame:
    """The first row by order of each combination of keys; nulls are equal. Rows are folded before the shuffle, so a
    hot key costs one row a task."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumns(named).groupBy(*named).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def users_of(df: DataFrame) -> list[str]:
    """user_id, where df has it: each user's postings are a set of their own."""
    return [c for c in ("user_id",) if c in df.columns]


def first_by_url(jobs: DataFrame) -> DataFrame:
    return first_by(jobs, [*map(F.col, users_of(jobs)), F.col("job_url")])


def first_by_title(jobs: DataFrame) -> DataFrame:
    return first_by(jobs, [*map(F.col, users_of(jobs)), bare_title(F.col("title")), bare_title(F.col("company"))])


def unseen(jobs: DataFrame, seen: DataFrame, keys=("user_id", "job_url")) -> DataFrame:
    return jobs.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def _units(lists, width: int) -> np.ndarray:
    """Rows of length 1, or 0 for zero vectors, of an Arrow column of lists; shorter vectors end in zeros, which is what a common
    prefix means. A vector with a null in it is near none."""
    out = np.zeros((len(lists), width))
    at = 0
    for own in lists.chunks:
        offsets = own.offsets.to_numpy()
        sizes = np.diff(offsets)
        values = own.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
        out[at + np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
        at += len(sizes)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, np.where(norm > 0, norm, 1.0), out=out)


def _near(a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a have a product >= threshold with a row of b of another key. Products in single precision, PRODUCTS at a time,
    tell which rows are beyond doubt; the others that may be near are multiplied again in double."""
    some, doubt = max(1, PRODUCTS // len(b)), (a.shape[1] + 8) * 2.0**-23
    found = np.zeros(len(a), bool)
    single, other = a.astype(np.float32), b.astype(np.float32).T
    for i in range(0, len(a), some):
        rough = single[i : i + some] @ other
        open_ = np.flatnonzero((rough >= threshold - doubt).any(axis=1))
        if not len(open_):
            continue
        differ = keys_a[i + open_][:, None] != keys_b[None, :]
        sure = ((rough[open_] >= threshold + doubt) & differ).any(axis=1)
        found[i + open_[sure]] = True
        maybe = ~sure & ((rough[open_] >= threshold - doubt) & differ).any(axis=1)
        del rough
        if maybe.any():
            found[i + open_[maybe]] = ((a[i + open_[maybe]] @ b.T >= threshold - 1e-12) & differ[maybe]).any(axis=1)
    return found


def drop_similar(jobs: DataFrame, history: DataFrame, threshold: float = SAME_POSTING, block: int = BLOCK, key: str = "job_url", within: tuple[str, ...] = ()) -> DataFrame:
    """jobs without those whose embedding has cosine >= threshold with another posting of history (of the same values of
    within, such as the user); rows without a vector stay. Exact: both sides are dealt into blocks, each pair of blocks is a matrix
    product in one task, and only keys that are hit come out. jobs and history: key, embedding, and what is in within.

    Each row goes to a task once per block of the other side, so blocks are large: of so many rows or BLOCK_VALUES numbers. Up to
    LEAST blocks a side there are more, to have work for all cores. A task holds two blocks and PRODUCTS products.
    """
    names = [f"_w{i}" for i in range(len(within))]

    def side(df: DataFrame) -> DataFrame:
        own = [F.col(c).cast("string").alias(n) for c, n in zip(within, names, strict=True)]
        # floats travel as floats; they are widened where they are multiplied
        vector = F.col("embedding") if df.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
        return df.where(F.col("embedding").isNotNull()).select(*own, F.col(key).cast("string").alias("k"), vector.alias("v"))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        rows = F.count(F.lit(1))
        few = F.least(F.lit(LEAST), F.ceil(rows / LEAST_ROWS))
        return df.groupBy(*names).agg(F.greatest(F.ceil(rows / block), F.ceil(F.sum(F.size("v")) / BLOCK_VALUES), few).alias(name))

    def hits(a, b):
        import pyarrow as pa

        if not len(a) or not len(b):
            return pa.table({n: pa.array([], pa.string()) for n in ["k", *names]})
        keys = pd.factorize(pd.concat([a["k"].to_pandas(), b["k"].to_pandas()], ignore_index=True))[0].astype(np.int32)
        width = max(1, *(pc.max(pc.list_value_length(t["v"])).as_py() for t in (a, b)))
        near = _near(_units(a["v"], width), _units(b["v"], width), keys[: len(a)], keys[len(a) :], threshold)
        return a.filter(pa.array(near)).select(["k", *names])

    new, old = side(jobs), side(history)
    # one row per group; without groups one row in all
    counts = blocks(new, "_n").join(blocks(old, "_m"), names) if names else blocks(new, "_n").crossJoin(blocks(old, "_m"))
    met = lambda df: df.join(counts, names) if names else df.join(F.broadcast(counts))
    spread = lambda most: F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col(most), F.lit(1)) - 1))
    deal = lambda most: F.pmod(F.xxhash64("k", "v"), F.greatest(F.col(most), F.lit(1)))
    left = met(new).select(*names, "k", "v", deal("_n").alias("a"), spread("_m").alias("b")).groupBy(*names, "a", "b")
    right = met(old).select(*names, "k", "v", spread("_n").alias("a"), deal("_m").alias("b")).groupBy(*names, "a", "b")
    found = left.cogroup(right).applyInArrow(hits, "k string" + "".join(f", {n} string" for n in names)).distinct().withColumnRenamed("k", "_hit")
    same = F.col(key).cast("string") == F.col("_hit")
    for c, n in zip(within, names, strict=True):
        same = same & (F.col(c).cast("string") == F.col(n))
    return jobs.join(found, same, "left_anti")


def drop_similar_lsh(jobs: DataFrame, history: DataFrame, threshold: float = SAME_POSTING, key: str = "job_url", planes: int = 16, tables: int = 12, seed: int = 7) -> DataFrame:
    """The same rows as drop_similar(), found in two passes. Most postings that have a near copy share a bucket of random
    hyperplanes with it: each bucket keeps two postings of history, so a hot bucket costs two comparisons a row. Only what no
    bucket has settled goes through the exact product of blocks.
    """
    first = history.where(F.col("embedding").isNotNull()).select("embedding").limit(1).collect()
    if not first:
        return jobs
    normals = np.random.default_rng(seed).normal(size=(len(first[0][0]), tables * planes))
    bits = 1 << np.arange(planes)

    @F.pandas_udf("array<int>")
    def codes(v: pd.Series) -> pd.Series:
        own = np.zeros((len(v), normals.shape[0]))
        for i, x in enumerate(v):
            own[i, : min(len(x), own.shape[1])] = x[: own.shape[1]]
        return pd.Series(list((((own @ normals) >= 0).reshape(len(v), tables, planes) * bits).sum(2).astype(np.int32)))

    def keyed(df: DataFrame, name: str, vector: str) -> DataFrame:
        some = df.where(F.col("embedding").isNotNull()).select(F.col(key).alias(name), F.col("embedding").alias(vector), codes("embedding").alias("_codes"))
        return some.select(name, vector, F.posexplode("_codes").alias("_table", "_code"))

    row = F.struct("_past", "_old")
    kept = keyed(history, "_past", "_old").groupBy("_table", "_code").agg(F.array(F.min(row), F.max(row)).alias("_two"))
    past = kept.select("_table", "_code", F.explode(F.array_distinct("_two")).alias("_x")).select("_table", "_code", "_x.*")
    met = keyed(jobs, key, "_new").join(past, ["_table", "_code"]).where((F.col(key) != F.col("_past")) & (cosine(F.col("_new"), F.col("_old")) >= threshold))
    return drop_similar(jobs.join(met.select(key).distinct(), key, "left_anti"), history, threshold, key=key)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_row")).select("_row.*")


def ranked(df: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key by order, numbered."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
