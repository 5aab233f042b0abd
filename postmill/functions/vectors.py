"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine on the prefix both vectors have; 0 for a null, empty or zero vector. Norms are those of the whole vectors."""
    n = F.least(F.size(a), F.size(b))
    dot = _sum(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    length = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (n <= 0), F.lit(0.0)).when(length == 0, F.lit(0.0)).otherwise(dot / length)


def unit(v: Column) -> Column:
    norm = F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def to_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def from_literal(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def units(lists):
    """A matrix of the vectors of an Arrow array of lists of doubles, each with length 1, or 0 for zero and empty vectors and for nulls in
    them; shorter vectors end in zeros, which is what a common prefix means. For use in tasks."""
    import numpy as np

    flat = lists.combine_chunks()
    offsets = flat.offsets.to_numpy()
    values = flat.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = np.nan_to_num(values)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)
