"""Quality scores learnt from pairwise preferences.

Bradley-Terry: each labelled good document is preferred to each labelled bad one; the score of a document is linear in
its features, and the weights minimise the logistic loss of feature differences over preference pairs. The threshold
is the quantile of the training scores that leaves as large a share below it as the labels call bad.

Contract. Null text: empty, scored like any other. Labels: rows (doc_id, quality) with quality 0 or 1; others are left
out. Only rows whose crc32 of the id mod FOLDS is not 0 are learnt from. The fit has three documented bounds, whatever the
size of the tables: MAX_LABELLED labels (those whose hash is smallest, with ties by id), twice as many documents of
them where ids repeat, and PAIRS preference pairs drawn from these with a fixed seed; every document is scored. With no
labels, or of one kind only, all documents score 0.5. Repeated labels count as often as they stand there; repeated
documents get equal scores, and equal scores lie on one side of the threshold. Texts of any length are read whole, in one pass
for each feature. An empty table gives no rows. Columns other than doc_id and text are no inputs of a score; they stay, but for those named score or predicted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import SPACES, whole_text

FOLDS = 5
MAX_LABELLED = 20_000
PAIRS = 40_000
ACCEPT = 0.3
FEATURES = ("length", "word_length", "upper", "digit", "symbol", "pipe", "bang", "distinct", "repeat", "stop", "line")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _times(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _kept(text: Column, others: str) -> Column:
    """Number of characters of text that are not of the pattern others."""
    return F.length(F.regexp_replace(text, others, ""))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with x, an array<double> of FEATURES, each between 0 and about 1."""
    t = F.col(text)
    step = docs.withColumn("_words", F.array_remove(F.split(t, f"[{SPACES}]+"), ""))
    w, n = F.col("_words"), F.greatest(F.size("_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    short = F.size(F.filter(w, lambda x: F.length(x) <= 3))
    # words equal to the one before: pairs of neighbours, compared in one walk
    same = F.size(F.filter(F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))
    values = [
        F.least(F.log1p(F.length(t).cast("double")) / 12.0, F.lit(1.0)),
        F.least(chars / n / 20.0, F.lit(1.0)),
        _kept(t, "[^\\p{Lu}]+") / chars,
        _kept(t, "[^0-9]+") / chars,
        F.least(_kept(t, "[^#$%&*@^~<>=+_\\\\{}\\[\\]]+") / n, F.lit(3.0)) / 3.0,
        F.least(_times(t, "|") / n, F.lit(1.0)),
        F.least((_times(t, "!") + _times(t, "?")) / n, F.lit(2.0)) / 2.0,
        F.size(F.array_distinct(w)) / F.pow(n, F.lit(0.8)) / 4.0,
        same / n,
        short / n,
        F.least(_times(t, "\n") / n, F.lit(1.0)),
    ]
    return step.withColumn("x", F.array(*[v.cast("double") for v in values])).drop("_words")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """The model: mean and spread of the features, weights, and the threshold on the raw score."""
    import numpy as np

    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    # at most max_labelled rows of 12 bytes, whatever the size of the tables
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled)
    joined = docs.select(F.col("doc_id").alias("id"), whole_text().alias("text")).join(F.broadcast(sample), "id")
    rows = with_features(joined).select("id", "y", "x").orderBy(F.xxhash64("id"), "id", "y", "x").limit(2 * max_labelled).collect()
    if len({r["y"] for r in rows}) < 2:
        return {"weights": [0.0] * len(FEATURES), "mean": [0.0] * len(FEATURES), "spread": [1.0] * len(FEATURES), "cut": None}
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = (x - mean) / spread
    pick = np.random.default_rng(6)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[pick.choice(good, PAIRS)] - z[pick.choice(bad, PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton steps on the penalised logistic loss of the differences
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / len(d) - 1e-3 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    s = np.sort(z @ w)
    cut = (s[len(bad) - 1] + s[len(bad)]) / 2
    return {"weights": w.tolist(), "mean": mean.tolist(), "spread": spread.tolist(), "cut": float(cut)}


def score(docs: DataFrame, model: dict, accept: float = ACCEPT) -> DataFrame:
    """docs (doc_id, text and others) with score and predicted; a raw score at the threshold becomes accept."""
    scale = [w / s for w, s in zip(model["weights"], model["spread"], strict=True)]
    shift = 0.0 if model["cut"] is None else model["cut"] - math.log(accept / (1 - accept))
    start = -shift - sum(w * m for w, m in zip(scale, model["mean"], strict=True))
    raw = F.aggregate(F.zip_with(F.col("_q.x"), F.array(*map(F.lit, scale)), lambda x, w: x * w), F.lit(start), lambda s, x: s + x)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), whole_text().alias("text"))
    out = with_features(held).select("_row", F.struct("x").alias("_q"))
    # an expression that is not deterministic: filters on the score stay above it, and features are computed once
    value = F.when(F.spark_partition_id() >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-raw)))
    rest = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return out.select(*rest, value.alias("score")).withColumn("predicted", (F.col("score") >= accept).cast("int"))
