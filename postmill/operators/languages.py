"""Language of a text by profiles of three-letter sequences.

A profile has, for each of SLOTS numbers that three characters in a row are hashed to, a penalty: minus SCALE times the
logarithm of how likely the sequence is in that language, smoothed and cut at WORST. The language with the least sum over a
text's sequences is taken. Profiles are arrays in the plan, three languages to an array of 64-bit numbers, so the sums of a
text are a walk over its sequences per three languages, without join or shuffle.

The profiles that come along are counted from postmill.language_texts; profiles() counts others from a labelled table.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.dictionary import bound
from postmill.language_texts import TEXTS

SLOTS, SMOOTH, SCALE, WORST = 2039, 0.1, 20, 255
#: A text's first SAMPLE characters tell; of more than three times STRETCH, their first, middle and last STRETCH do. WORST times these
#: fits in BITS.
SAMPLE, STRETCH, BITS = 2000, 200, 21
FIRST, SECOND = 961, 31
#: Texts whose sequences are counted at once; one of more characters than that is the last of its lot.
SLAB_TEXTS = 256


def letters(text: Column) -> Column:
    """Lower case, with one blank for all that stands between letters and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def sample(text: Column) -> Column:
    def of(some: Column) -> Column:
        n = F.length(some)
        three = F.concat_ws(" ", F.substring(some, 1, STRETCH), F.substring(some, F.floor((n - STRETCH) / 2).cast("int") + 1, F.lit(STRETCH)), F.substring(some, n - STRETCH + 1, F.lit(STRETCH)))
        return F.when(n > 3 * STRETCH, three).otherwise(some)

    return bound(F.substring(text, 1, SAMPLE), of)


def slots(text: Column) -> Column:
    """array<int>: the slot of each three characters in a row, from 0."""

    def of(codes: Column) -> Column:
        n = F.greatest(F.size(codes) - 2, F.lit(0))
        # arrays of equal length, so that none is looked up by place
        pairs = F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * FIRST + b * SECOND)
        return F.zip_with(pairs, F.slice(codes, F.lit(3), n), lambda ab, c: F.pmod(ab + c, F.lit(SLOTS)))

    return bound(F.transform(F.split(letters(text), ""), F.ascii), of)


def _slot_counts(texts: list[str]):
    """How often each slot comes in texts that letters() gave, as slots() has them."""
    import numpy as np

    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    if len(codes) < 3:
        return np.zeros(SLOTS, np.int64)
    found = (codes[:-2] * np.int32(FIRST) + codes[1:-1] * np.int32(SECOND) + codes[2:]) % np.int32(SLOTS)
    # not the sequences that begin in one text and end in another
    ends = np.cumsum([len(t) for t in texts])[:-1]
    inside = np.ones(len(found), bool)
    for back in (1, 2):
        cut = ends - back
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    return np.bincount(found[inside], minlength=SLOTS)


def profiles(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, slot, penalty of a labelled table, for the slots that its texts have, and with slot null for all other slots. Rows
    without text or language are left out."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            slab: dict = {}
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some = slab.setdefault(name, [])
                some.append(own.as_py())
                # a few characters at a time, whatever a batch weighs
                if len(some) == SLAB_TEXTS or len(some[-1]) > SLAB_TEXTS:
                    sums[name] = sums.get(name, 0) + _slot_counts(slab.pop(name))
            for name, some in slab.items():
                sums[name] = sums.get(name, 0) + _slot_counts(some)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "slot", "n"])

    whole = texts.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), letters(F.col(text)).alias("t"))
    # a task counts its texts' sequences into SLOTS sums a language; only those are shuffled
    counts = whole.mapInArrow(counted, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    every = counts.unionByName(totals.select("lang", F.lit(None).cast("int").alias("slot"), F.lit(0).cast("bigint").alias("n")))
    share = (F.col("n") + F.lit(SMOOTH)) / (F.col("total") + F.lit(SMOOTH * SLOTS))
    return every.join(totals, "lang").select("lang", "slot", F.least(F.lit(WORST), F.round(-SCALE * F.log(share)).cast("int")).alias("penalty"))


def model(table: DataFrame) -> dict[str, list[int]]:
    """Penalties by language from a table that profiles() gave, languages in order of name: at most SLOTS + 1 rows per language."""
    found: dict[str, list] = {}
    rest = {}
    for r in table.collect():
        if r["slot"] is None:
            rest[r["lang"]] = r["penalty"]
        else:
            found.setdefault(r["lang"], [None] * SLOTS)[r["slot"]] = r["penalty"]
    return {lang: [rest[lang] if p is None else p for p in found.get(lang, [None] * SLOTS)] for lang in sorted(rest)}


@functools.cache
def own_profiles() -> dict[str, list[int]]:
    """The profiles of TEXTS, English first."""
    import regex

    out = {}
    for lang, text in TEXTS.items():
        codes = [ord(c) for c in " " + regex.sub(r"[^\p{L}]+", " ", text.lower()).strip() + " "]
        counts = [0] * SLOTS
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[(a * FIRST + b * SECOND + c) % SLOTS] += 1
        total = sum(counts) + SMOOTH * SLOTS
        out[lang] = [min(WORST, round(-SCALE * math.log((n + SMOOTH) / total))) for n in counts]
    return out


def detect(text: Column, known: dict[str, list[int]] | None = None) -> Column:
    """The language of a text by its sample; of equal ones, and where there is no letter, the first of known (English, if
    none is given). Null text: null."""
    known = own_profiles() if known is None else known
    names = list(known)
    packs = [names[i : i + 3] for i in range(0, len(names), 3)]
    # constant, so Spark makes each an array once
    tables = [F.split(F.lit(",".join(str(sum(known[n][s] << (BITS * k) for k, n in enumerate(pack))) for s in range(SLOTS))), ",").cast("array<bigint>") for pack in packs]
    mask = (1 << BITS) - 1

    def added(table: Column):
        return lambda total, slot: total + F.get(table, slot)

    def sums(own: Column) -> Column:
        return F.array(*[F.aggregate(own, F.lit(0).cast("bigint"), added(t)) for t in tables])

    def least(packed: Column) -> Column:
        each = [F.struct(F.shiftright(packed[i // 3], BITS * (i % 3)).bitwiseAND(F.lit(mask)).alias("penalty"), F.lit(i).alias("place"), F.lit(n).alias("lang")) for i, n in enumerate(names)]
        return F.array_min(F.array(*each))["lang"]

    judged = lambda t: bound(slots(sample(t)), lambda own: bound(sums(own), least))
    return bound(text, lambda t: F.when(t.isNotNull(), judged(t)))
