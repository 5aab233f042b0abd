"""Mixing of sources to target weights.

Hash-threshold histograms. A document's place is a 60-bit hash of its id. Sizes are summed by source and hash bucket;
the bucket in which a source's running sum crosses its budget is the only one that is looked into again, with the
next bits of the hash, until the threshold is one hash. Documents below it are taken, with no sort of the documents.
Rows that share the id at the threshold are split the same way by a hash of the row, so a hot id is not all or nothing.
What whole documents leave of the budget is filled the same way from documents of at most an eighth of that gap.

Budgets nest: a source whose target is q times its size and a rest takes each document q times, and those below
the threshold once more; no document is taken more than twice.

Contract. Null text: size 0. A null source is a source, the last in order. Documents with the same id (repeated rows)
share a hash; only at a source's threshold are they told apart, by text and then by their place in the input, which must
therefore be a table or file that reads the same again. A null id counts as an empty one. Sizes of 0 are never below a
threshold's need but may be taken with no effect. Texts of any length are read whole. An empty table gives no rows; other
columns stay. Reruns give the same mix; so do other partitionings, but for which of several equal rows are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import SPACES, small_side, stored, whole_text

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BITS = 10
LEVELS = 6
SMALL = 8
HALF = 30
#: Tables of one row per source are broadcast up to so many sources (about 100 bytes each).
MOST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Number of runs of other characters than white space."""
    # each run becomes one x; the white space between goes
    return F.octet_length(F.translate(F.regexp_replace(text, f"[^{SPACES}]++", "x"), " \t\n\x0b\f\r", "")).cast("bigint")


def place(doc_id: Column) -> Column:
    """60 bits of the id's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def row_hash() -> Column:
    """60 bits that tell rows of one id apart: HALF of the text's hash, then HALF of the hash of the row's place."""
    half = F.lit((1 << HALF) - 1).cast("bigint")
    return F.shiftleft(F.xxhash64(whole_text()).bitwiseAND(half), HALF).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(half))


def ranked(by_source: DataFrame) -> DataFrame:
    """by_source with place, from 0 by source with null last: range partitions number their own rows, and start at
    the sum of the counts before them, so no task sees all sources."""
    last = F.col("source").isNull().cast("int")
    ranged = stored(by_source.withColumn("last", last).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()), "mix-ranged")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # one row per partition, whatever the number of sources
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1
    return ranged.withColumn("own", own).join(F.broadcast(before), "part").withColumn("place", F.col("own") + F.col("before")).drop("part", "last", "own", "before")


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, source_size, target of each row (key, source, source_size), one row per source.

    The shares of all sources are level * weight, and most * size where that is less. The level rises from that of all
    sources open, as those that are full pass their excess on, until no other one is full; each time the driver gets sums only.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    weighted = stored(ranked(by_source).select("key", "source_size", weight.alias("weight")), "mix-weights")
    cap = F.lit(most) * F.col("source_size")
    level, full = None, -1
    while True:
        filled = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        x = weighted.agg(F.sum("source_size").alias("size"), F.sum(F.when(filled, cap)).alias("held"), F.sum(F.when(~filled, F.col("weight"))).alias("open"), F.count(F.when(filled, 1)).alias("full")).first()
        if not x["open"]:
            level = None
            break
        if x["full"] == full:
            break
        level, full = (share * x["size"] - (x["held"] or 0)) / x["open"], x["full"]
    target = cap.cast("double") if level is None else F.least(F.lit(level) * F.col("weight"), cap.cast("double"))
    return weighted.select("key", "source_size", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, hash, own (a hash of the row) and key (the source, null as one of its own)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    return docs.withColumns({"size": n_words(whole_text()), "hash": place(F.col("doc_id")), "own": row_hash(), "key": key})


def _crossing(rows: DataFrame, low: int) -> DataFrame:
    """key, budget, total, below, edge bucket and what it holds: for rows (key, budget, base, size, hash) the first
    bucket of hashes, by their bits above low, at which base and the sizes so far exceed the budget; none if all fit."""
    sums = rows.groupBy("key", "budget", "base", F.shiftright("hash", low).alias("own")).agg(F.sum("size").alias("held"), F.min("hash").alias("first"), F.max("hash").alias("last"))
    per_key = Window.partitionBy("key")
    upto = F.col("base") + F.sum("held").over(per_key.orderBy("own"))
    found = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("own", "held", "upto", "first", "last")))
    return (
        sums.withColumns({"upto": upto, "total": F.col("base") + F.sum("held").over(per_key)})
        .groupBy("key", "budget")
        .agg(found.alias("x"), F.max("total").alias("total"))
        .select("key", "budget", F.coalesce(F.col("x.upto") - F.col("x.held"), F.col("total")).alias("below"), F.col("x.own").alias("own"), F.col("x.held").alias("held"), F.col("x.first").alias("edge"), F.col("x.last").alias("last"))
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """key, budget, below, edge, held: rows (key, size, hash) of a key with hash < edge sum to below <= budget; with
    those at edge, which hold so much, they exceed it. No edge: all fit. Refines only boundary buckets."""
    bounds = stored(_crossing(rows.join(small_side(budgets, MOST_SOURCES), "key").withColumn("base", F.lit(0).cast("bigint")), 60 - BITS), "mix")
    for level in range(1, LEVELS):
        split = F.coalesce(F.col("edge") < F.col("last"), F.lit(False))
        if bounds.where(split).isEmpty():
            break
        low = 60 - (level + 1) * BITS
        edges = bounds.where(split).select("key", "budget", F.col("below").alias("base"), "own")
        inside = rows.join(small_side(edges, MOST_SOURCES), "key").where(F.shiftright("hash", low + BITS) == F.col("own"))
        bounds = stored(bounds.where(~split).unionByName(_crossing(inside, low)), "mix")
    return bounds.select("key", "budget", "below", "edge", "held")


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per key of rows (source, key, size, hash, own): source_size, target and the thresholds that decide copies."""
    by_source = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goals = stored(
        targets(by_source, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-goals",
    )
    core = rows.select("key", "size", "hash")
    first = stored(thresholds(core, goals.select("key", "budget")).withColumn("gap", F.col("budget") - F.col("below")).drop("budget", "below", "held"), "mix-first")
    # the rows of the id at the threshold, by their own hash
    tied = rows.join(small_side(first.where("edge is not null").select("key", "edge"), MOST_SOURCES), "key").where("hash = edge").select("key", "size", F.col("own").alias("hash"))
    own = thresholds(tied, first.select("key", F.col("gap").alias("budget"))).select("key", F.col("below").alias("part"), F.col("edge").alias("own_edge"), "held")
    first = first.join(own, "key", "left").withColumn("gap", F.col("gap") - F.coalesce("part", F.lit(0))).drop("part")
    small = F.when(F.col("edge").isNotNull(), F.floor(F.col("gap") / SMALL).cast("bigint"))
    goals = stored(goals.join(first, "key", "left").withColumn("small", small), "mix-goals")
    rest = core.join(small_side(goals.select("key", "edge", "small"), MOST_SOURCES), "key").where((F.col("hash") > F.col("edge")) & (F.col("size") <= F.col("small"))).select("key", "size", "hash")
    second = thresholds(rest, goals.select("key", F.col("gap").alias("budget"))).select("key", F.col("below").alias("fill"), F.col("edge").alias("edge2"), F.col("held").alias("held2"))
    left = F.col("gap") - F.coalesce("fill", F.lit(0))
    over = F.col("held2") - left
    with_edge = F.col("held") - F.col("gap") < F.when(over < left, over).otherwise(left)
    return stored(
        goals.join(second, "key", "left").select("key", "source_size", "target", "whole", "edge", "own_edge", "small", "edge2", F.coalesce(with_edge, F.lit(False)).alias("with_edge"), F.coalesce(over < left, F.lit(False)).alias("with_edge2")),
        "mix-plan",
    )


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (key, size, hash, own and others) with source_size, target and copies, by plan."""
    at, edge, edge2 = F.col("hash"), F.col("edge"), F.col("edge2")
    own, own_edge = F.col("own"), F.col("own_edge")
    below = edge.isNull() | (at < edge) | ((at == edge) & ((own < own_edge) | (F.col("with_edge") & (own == own_edge))))
    filling = ~F.col("with_edge") & (at > edge) & (F.col("size") <= F.col("small")) & (edge2.isNull() | (at < edge2) | (F.col("with_edge2") & (at == edge2)))
    more = (below | F.coalesce(filling, F.lit(False))) & (F.col("whole") < MOST)
    return rows.join(small_side(plan, MOST_SOURCES), "key").withColumn("copies", F.col("whole") + more.cast("bigint")).drop("key", "hash", "own", "whole", "edge", "own_edge", "small", "edge2", "with_edge", "with_edge2")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """docs, each row as many times as the mix takes it."""
    own = [c for c in docs.columns]
    # the operator's columns get names of their own, so that columns of docs may be called anything
    core = sized(docs.select("doc_id", "text", "source"))
    decided = plan(stored(core.select("source", "key", "size", "hash", "own"), "mix-sizes"), weights, share)
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "doc_id", "text", "source")
    taken = mixed(sized(carried), decided).select("row", "copies")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
