"""Hard negatives: for each anchor and each of its positives, the best rows of other labels whose scores lie in a window
below the positive's.

Threshold joins after L2AP, block by block. A query asks for the best rows of a window of scores, so it has a threshold:
no row below it is of use. Dimensions are put in order of energy; the inverted index of a block of candidates holds of
each row only its first dimensions, up to where the norm of the rest times the queries' largest norm of the rest stays
below the lowest threshold. Rows are sorted by the length of that part, so a dimension's posting list is a range of rows,
and partial scores of all queries accumulate by range. Pairs are given up as soon as partial score plus the product of the
remaining norms is below the query's threshold; the others get the dimensions that the index left out. Thresholds start
high and go down, for the queries whose windows are not full yet, until they are or the window ends.

Before all blocks are met, one block of the candidates gives each window a floor: as many of its rows as are wanted reach it, so
the final ones do. That raises thresholds, and leaves most blocks with few rows to hand on. It decides no result.

Contract. Scores are inner products of 64-bit integer weights; higher ones first, ties by smaller vec_id. Rows with a null
vec_id, label or vector take no part, nor do rows with the anchor's own id. Vectors of different lengths are compared on
the dimensions that both have. Repeated rows count as rows, as anchors, positives and negatives. An anchor without
positives, or whose windows hold no rows, gives none; so do empty tables. Extra columns are left out. Labels are compared
as text, and one label may hold any share of the rows: rows are dealt into blocks by number, not by label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import settled, stored

QUERY_BLOCK, AT_ONCE = 4096, 64
LEAST_BLOCK, MOST_BLOCK = 1024, 32768
#: Dimensions that are accumulated together.
STEP = 8
#: Parts of the way from a window's lower end to its upper end at which thresholds stand, one after the other.
LEVELS = (0.75, 0.5, 0.25, 0.0)
#: Share of pairs still alive under which they are followed one by one.
SPARSE = 0.1
#: Scores that no row reaches; sums below EXACT are exact as doubles.
LOWEST, HIGHEST, EXACT = -(1 << 62), 1 << 62, 1 << 53
FOUND = "query_row bigint, window int, vec_id bigint, score bigint"


class Block:
    """Rows of weights (matrix), dimensions in order of energy and padded to whole steps, with norms of what is left after each step."""

    def __init__(self, matrix, order=None):
        import numpy as np

        self.order = np.argsort(-(matrix.astype(np.float64) ** 2).sum(0), kind="stable") if order is None else order
        matrix = matrix[:, self.order]
        pad = -matrix.shape[1] % STEP
        self.rows = np.pad(matrix, ((0, 0), (0, pad))) if pad else matrix
        self.steps = self.rows.shape[1] // STEP
        squares = (self.rows.astype(np.float64) ** 2).reshape(len(matrix), self.steps, STEP).sum(2)
        rest = np.cumsum(squares[:, ::-1], 1)[:, ::-1]
        # a little more than the true norm, so that rounding gives no pair up
        self.norms = np.sqrt(np.concatenate([rest, np.zeros((len(matrix), 1))], 1)) * (1 + 1e-9)


def reaching(rows: Block, queries: Block, least):
    """Row numbers of queries and of rows, and their scores, of all pairs whose score reaches least, which holds one
    threshold per query."""
    import numpy as np

    steps = rows.steps
    indexed = (rows.norms[:, :steps] * queries.norms.max(0)[:steps] >= least.min()).sum(1)
    order = np.argsort(-indexed, kind="stable")
    indexed = indexed[order]
    lists = np.searchsorted(-indexed, -np.arange(1, steps + 1), "right")  # of each step, the rows that have it in the index
    own, norms = rows.rows[order[: lists[0]]], rows.norms[order[: lists[0]]] if steps else rows.norms[:0]
    indexed, n = indexed[: lists[0]], lists[0]
    partial = np.zeros((len(least), n), own.dtype)
    tests = {steps // 4, steps // 2, 3 * steps // 4} - {0}
    for k in range(steps):
        if lists[k]:
            part = slice(k * STEP, k * STEP + STEP)
            partial[:, : lists[k]] += queries.rows[:, part] @ own[: lists[k], part].T
        if k + 1 in tests or k + 1 == steps:
            done = np.minimum(indexed, k + 1)
            alive = partial + queries.norms[:, done] * norms[np.arange(n), done] >= least[:, None]
            if k + 1 == steps or alive.mean() < SPARSE:
                break
    else:  # no dimension at all
        done, alive = indexed, partial >= least[:, None]
    q, i = np.nonzero(alive)
    score, at = partial[q, i], done[i]
    for k in range(steps):
        late = np.flatnonzero(at <= k)
        if not len(late):
            continue
        part = slice(k * STEP, k * STEP + STEP)
        for some in np.array_split(late, -(-len(late) // 100_000)):
            score[some] += (queries.rows[q[some], part] * own[i[some], part]).sum(1)
        alive = score + queries.norms[q, np.maximum(at, k + 1)] * norms[i, np.maximum(at, k + 1)] >= least[q]
        q, i, score, at = q[alive], i[alive], score[alive], at[alive]
    return q, order[i], score


def window_best(rows: Block, ids, queries: Block, own_ids, low, high, want: int):
    """Query, window, row and score of the want best rows in each query's windows [low, high], given as matrices; ids ascend."""
    import numpy as np

    most = queries.norms[:, 0] * rows.norms[:, 0].max() + 1
    bottom = np.maximum(low.min(1), -most)
    top = np.maximum(np.minimum(high.max(1), most), bottom)
    some = (low <= high).any(1) & (bottom <= most)
    out = [(np.zeros(0, np.int64),) * 4]
    for level in LEVELS:
        asked = np.flatnonzero(some)
        if not len(asked):
            break
        least = bottom[asked] + level * (top[asked] - bottom[asked])
        part = Block.__new__(Block)
        part.rows, part.norms, part.steps = queries.rows[asked], queries.norms[asked], queries.steps
        q, i, score = reaching(rows, part, least)
        score = score.astype(np.int64)
        other = ids[i] != own_ids[asked][q]
        q, i, score = q[other], i[other], score[other]
        full = np.ones(len(asked), bool)
        kept = []
        for w in range(low.shape[1]):
            lo, hi = low[asked, w], high[asked, w]
            inside = (score >= lo[q]) & (score <= hi[q])
            qw, iw, sw = q[inside], i[inside], score[inside]
            best = np.lexsort((iw, -sw, qw))
            qw, iw, sw = qw[best], iw[best], sw[best]
            place = np.arange(len(qw)) - np.searchsorted(qw, qw)
            qw, iw, sw = (x[place < want] for x in (qw, iw, sw))
            # below the threshold nothing was looked at, so a window with room is done only if it ends above
            full &= (np.bincount(qw, minlength=len(asked)) >= want) | (np.maximum(lo, bottom[asked]) >= least) | (lo > hi)
            kept.append((qw, np.full(len(qw), w), iw, sw))
        for qw, ww, iw, sw in kept:
            done = full[qw]
            out.append((asked[qw[done]], ww[done], iw[done], sw[done]))
        some[asked[full]] = False
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _matrix(column, width: int):
    import numpy as np

    vectors = column.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    places = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    short = places < width
    out[np.repeat(np.arange(len(sizes)), sizes)[short], places[short]] = flat[short]
    return out


def block_best(candidates, queries, want: int, same: bool):
    """Arrow table of FOUND: the want best candidates of each query's windows, of its label (same) or of others."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if not candidates.num_rows or not queries.num_rows:
        return pa.schema([("query_row", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())]).empty_table()
    candidates = candidates.sort_by("vec_id")
    width = max(pc.max(pc.list_value_length(t.column("weights"))).as_py() or 0 for t in (candidates, queries))
    rows, asked = _matrix(candidates.column("weights"), width), _matrix(queries.column("weights"), width)
    longest = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(1)).max(initial=0))
    if longest(rows) * longest(asked) < EXACT:
        rows, asked = rows.astype(np.float64), asked.astype(np.float64)
    ids, own_ids, numbers = (t.column(c).to_numpy() for t, c in ((candidates, "vec_id"), (queries, "vec_id"), (queries, "query_row")))
    labels, own_labels = (np.array(t.column("label").to_pylist(), object) for t in (candidates, queries))
    low, high = (np.array(queries.column(c).to_pylist(), np.int64).reshape(len(asked), -1) for c in ("low", "high"))
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    for label in dict.fromkeys(own_labels):
        of_label = np.flatnonzero(own_labels == label)
        fit = np.flatnonzero((labels == label) if same else (labels != label))
        if not len(fit) or not low.shape[1]:
            continue
        block = Block(rows[fit])
        for at in range(0, len(of_label), AT_ONCE):
            some = of_label[at : at + AT_ONCE]
            q, w, i, score = window_best(block, ids[fit], Block(asked[some], block.order), own_ids[some], low[some], high[some], want)
            for column, values in zip(out, (numbers[some][q], w, ids[fit][i], score), strict=True):
                column.append(values)
    settled()
    values = [np.concatenate(x) for x in out]
    return pa.table({"query_row": pa.array(values[0], pa.int64()), "window": pa.array(values[1].astype(np.int32), pa.int32()), "vec_id": pa.array(values[2], pa.int64()), "score": pa.array(values[3], pa.int64())})


def best_in_windows(vectors: DataFrame, queries: DataFrame, want: int, same: bool) -> DataFrame:
    """FOUND and rank int: the want best of vectors (vec_id, label, weights) in each window of queries (query_row, vec_id, label,
    weights, low and high array<bigint>, whose windows have their number as place), of the query's label or of others."""
    n, m = vectors.count(), queries.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // (4 * cores)))
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // QUERY_BLOCK))
    keys = ["block", "query_block"]
    rows = vectors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def met(some: DataFrame, asked: DataFrame, some_blocks: int) -> DataFrame:
        numbers = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))
        left = some.withColumn("query_block", numbers(query_blocks))
        right = asked.withColumn("query_block", F.pmod(F.xxhash64("query_row"), F.lit(query_blocks))).withColumn("block", numbers(some_blocks))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: block_best(a, b, want, same), FOUND)

    if blocks > 2:
        # what one block has: floors of windows that it fills
        floors = met(rows.where("block = 0"), queries, 1).groupBy("query_row", "window").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= want)
        by_row = floors.groupBy("query_row").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("floors"))
        raised = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.element_at("floors", w), x)))
        queries = stored(queries.join(by_row, "query_row", "left").withColumn("low", F.when(F.col("floors").isNull(), F.col("low")).otherwise(raised)).drop("floors"), "floors")
    best = Window.partitionBy("query_row", "window").orderBy(F.desc("score"), "vec_id")
    return met(rows, queries, blocks).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= want)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of anchors and each of its positives, the
    negatives best rows of other labels for which least * positive_score <= 100 * score <= most * positive_score.

    Both tables: vec_id bigint, label, weights array<bigint>.
    """
    usable = "vec_id is not null and label is not null and weights is not null"
    taken = [F.col("vec_id"), F.col("label").cast("string").alias("label"), F.col("weights")]
    rows = vectors.where(usable).select(*taken)
    asked = stored(anchors.where(usable).select(F.monotonically_increasing_id().alias("query_row"), *taken), "anchors")
    ends = lambda x: F.array(F.lit(x).cast("bigint"))
    found = best_in_windows(rows, asked.withColumn("low", ends(LOWEST)).withColumn("high", ends(HIGHEST)), positives, True)
    own = stored(found.groupBy("query_row").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives")), "positives")
    # score * percent / 100 in integers, rounded up or down, without a product that overflows
    hundreds = lambda p: F.call_function("div", p["score"] - F.pmod(p["score"], F.lit(100)), F.lit(100))
    rest = lambda p, percent, more: F.floor((F.pmod(p["score"], F.lit(100)) * percent + more) / F.lit(100))
    low = F.transform("positives", lambda p: hundreds(p) * least + rest(p, least, 99))
    high = F.transform("positives", lambda p: hundreds(p) * most + rest(p, most, 0))
    windows = asked.join(own.select("query_row", low.alias("low"), high.alias("high")), "query_row")
    best = best_in_windows(rows, windows, negatives, False).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    named = asked.select("query_row", F.col("vec_id").alias("anchor_id")).join(own, "query_row").select("query_row", "anchor_id", F.posexplode("positives").alias("window", "p"))
    return (
        best.join(named, ["query_row", "window"])
        .select("anchor_id", F.col("p.id").alias("positive_id"), "rank", "negative_id", F.col("p.score").alias("positive_score"), "negative_score")
    )
