"""Which of many names a text may hold, told from its words in one pass, so that patterns run only on texts that can match."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that match others without regard to case but whose lower case is none of them, and what they match.
FOLDED = ("İıſK", "iisk")


def bound(value: Column, f) -> Column:
    """f(value), with value computed once: what stands in a function of arrays is computed anew wherever it is used."""
    return F.transform(F.array(value), f)[0]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.split(F.lower(F.translate(text, *FOLDED)), r"[^\p{L}\p{N}]+")


def _ends(parsed, begun: frozenset) -> frozenset:
    """What the first word can be, as (letters, whether it has ended), after what is parsed."""
    for op, value in parsed:
        name = str(op)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "LITERAL":
            begun = frozenset(_with(b, chr(value)) for b in begun)
        elif name == "IN":
            signs = {" " if str(kind) == "CATEGORY" else chr(v) for kind, v in value if str(kind) in ("LITERAL", "CATEGORY")}
            signs |= {chr(c) for kind, v in value if str(kind) == "RANGE" for c in range(v[0], v[1] + 1)}
            begun = frozenset(_with(b, c) for b in begun for c in signs)
        elif name == "BRANCH":
            begun = frozenset().union(*(_ends(way, begun) for way in value[1]))
        elif name == "SUBPATTERN":
            begun = _ends(value[3], begun)
        elif name == "MAX_REPEAT":
            least, most, part = value
            once = _ends(part, begun)
            if most > 1 and any(not ended for _, ended in once) and once != begun:
                raise ValueError("a word of no fixed length")
            begun = once if least else begun | once
        else:
            raise ValueError(f"no words from {name}")
    return begun


def _with(word: tuple[str, bool], sign: str) -> tuple[str, bool]:
    letters, ended = word
    if ended:
        return word
    return (letters + sign, False) if sign.isalnum() else (letters, bool(letters))


@cache
def first_words(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """The words that a match of any of patterns, as values.words() matches them, can begin with. Patterns are names with classes of
    blanks and signs, options and alternatives; a letter that may come any number of times is refused."""
    found = set()
    for p in patterns:
        found |= {w.lower() for w, _ in _ends(re._parser.parse(p), frozenset({("", False)}))}
    if "" in found:
        raise ValueError("a pattern without a word")
    return tuple(sorted(found))


def some_of(text: Column, words) -> Column:
    """array<string>: those of the text's words that are in words. Spark makes the list of constants a set once."""
    return F.filter(tokens(text), lambda w: w.isin(*words))
