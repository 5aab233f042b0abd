"""Shared beginnings and first words never change what a pattern matches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postmill import values as V
from postmill.functions.dictionary import first_words, some_of

LISTS = [*V.REGION_NAMES.values(), V.GEO_PLACES, *V.PATHS.values(), V.AI_ROLES, V.SOFTWARE_ROLES, V.LOCKED_PLACES, ("a", "ab", "a", "a?b", "x|y", "xz", "é")]


def texts(names, n=300):
    draw = random.Random(7)
    plain = lambda p: re.sub(r"\\s\*|\\s\+|\[.*?\]|\(\?[^)]*\)|[()?+*\\|]", draw.choice(["", " ", "-"]), p)
    return [" ".join(plain(draw.choice(names))[: draw.randint(1, 30)] + draw.choice(["", "x", "s", "n", " ", "."]) for _ in range(3)) for _ in range(n)] + [p for p in map(plain, names)]


@pytest.mark.parametrize("names", LISTS)
def test_shared_beginnings(names):
    whole = re.compile(r"(?i)\b(?:" + "|".join(n.replace(" ", r"\s+") for n in names) + r")\b")
    grouped = re.compile(V.words(names, "(?i)"))
    assert [bool(whole.search(t)) for t in texts(names)] == [bool(grouped.search(t)) for t in texts(names)]


def test_a_text_that_matches_has_a_first_word(spark):
    for names in (V.GEO_PLACES, *V.REGION_NAMES.values()):
        own = [*texts(names, 150), "İSTANBUL", "ISTANBUL", "Kenya", "Türkİye"]
        df = spark.createDataFrame([(t,) for t in own], "t string")
        rows = df.select(F.col("t").rlike(V.words(names)).alias("hit"), (F.size(some_of(F.col("t"), first_words(tuple(names)))) > 0).alias("some")).collect()
        assert all(r["some"] for r in rows if r["hit"]) and any(r["hit"] for r in rows) and any(not r["some"] for r in rows)


def test_words_of_patterns():
    assert first_words((r"st[.\s]+petersburg", r"\(p\)\s*ltd", r"abu\s*dhabi", "tulkar(?:e)?m", r"eu[-\s]based", "palestin(?:e|ian)")) == ("abu", "abudhabi", "eu", "p", "palestine", "palestinian", "st", "tulkarem", "tulkarm")
    with pytest.raises(ValueError):
        first_words(("a+b",))
