"""License scans.

Positional rare-token index. Templates are short licence notices; their words form the index: word to (template,
position). Each licence word of a file votes with its IDF over all files for (template, file position - template
position), so a notice shows as many votes for one offset however it is placed. Only offsets that one of the template's
own rarest words proposes are scored, on all words that stand there: the rarest words are taken until the others alone
cannot reach LEAST, so no offset that could reach it is left out, whatever else stands in the file. A template whose share of IDF at its
best offset reaches LEAST and whose mandatory key phrase stands in the file gives its label. Base phrases, found where
their words stand consecutively, give labels of their own.

Contract. Null text: empty. Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters; positions
count words from 0. Repeated rows are files of their own; an empty table gives no rows. The score is the best template's share, 0
without any. Extra columns are left out, whatever their names. Files of any length are read whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import lower_ascii, stored, whole_text

#: The base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label and words of each licence's short identifier, which files give behind `SPDX-License-Identifier`.
IDENTIFIERS = (("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("bsd", "bsd"), ("mpl-2.0", "mpl 2 0"), ("cc-by", "cc by"), ("cc0", "cc0"), ("isc", "isc"), ("unlicense", "unlicense"))
#: Label and heading of a licence's own text.
HEADINGS = (
    ("mit", "mit license"), ("apache-2.0", "apache license version 2 0"), ("gpl", "gnu general public license"), ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license"),
    ("bsd", "bsd 2 clause license"), ("bsd", "bsd 3 clause license"), ("mpl-2.0", "mozilla public license version 2 0"), ("cc-by", "creative commons attribution 4 0 international"), ("cc0", "cc0 1 0 universal"), ("isc", "isc license"), ("unlicense", "the unlicense"),
)
#: label, mandatory key phrase, notice: one-sentence notices, then headings and identifiers, which are their own key.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache license"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license version"),
    ("agpl", "affero general public license", "licensed under the gnu affero general public license version"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc0", "cc0", "released into the public domain under cc0 1 0 universal"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved", "copyright all rights reserved"),
    *((label, heading, heading) for label, heading in HEADINGS),
    *((label, f"spdx license identifier {words}", f"spdx license identifier {words}") for label, words in IDENTIFIERS),
)
#: Words of the templates that any text has; they are not indexed.
COMMON = frozenset("the is of to a any and this with you may not for as by it or under at in an on use be must above list following free file files charge person work terms into no 0 1 2 3 4 v".split())
LEAST = 0.6


def index(templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) of each word."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, notice) in enumerate(templates):
        for position, word in enumerate(notice.split()):
            if word not in COMMON:
                found.setdefault(word, []).append((t, position))
    return found


def proposing(idf: dict[str, float], templates=TEMPLATES, least: float = LEAST) -> set[tuple[int, int]]:
    """(template, position) of the rarest words of each template, so many that the others weigh less than least of it."""
    found = set()
    for t, (_, _, notice) in enumerate(templates):
        own = sorted((-idf[w], position) for position, w in enumerate(notice.split()) if w not in COMMON)
        others = total = -sum(weight for weight, _ in own)
        for weight, position in own:
            if others < least * total - 1e-9:
                break
            found.add((t, position))
            others += weight
    return found


def _spaced(text: Column) -> Column:
    """The words of text, with one space before each and one after the last; one space if there is none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(text), F.lit(" ")), BREAK, " ")


def _count(spaced: Column) -> Column:
    return F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))


def facts(files: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """row, doc_id, n_words, base (label, places, first, last of each base phrase), hits (word, position) and keys (the mandatory phrases that stand in it)."""
    words = sorted(index(templates))
    t = files.select("doc_id", _spaced(whole_text()).alias("t"))
    base = []
    for phrase, label in phrases:
        size = len(phrase.split())
        cut = F.split(F.col("t"), f" {phrase}(?= )", -1)
        n = F.size(cut) - 1
        last = _count(F.element_at(cut, -1)) - 1
        whole = F.struct(F.lit(label).alias("label"), n.cast("bigint").alias("places"), (_count(F.element_at(cut, 1))).cast("bigint").alias("first"), (_count(F.col("t")) - 1 - last - size).cast("bigint").alias("last"))
        base.append(F.when(F.contains("t", F.lit(f" {phrase} ")), whole))
    # words of the index are few; texts without any need no list of words
    any_word = " (?:" + "|".join(map(re.escape, words)) + ")(?= )"
    listed = F.split(F.substring(F.col("t"), 2, F.length("t")), " ")
    hits = F.filter(F.transform(listed, lambda w, i: F.struct(w.alias("word"), i.cast("bigint").alias("position"))), lambda h: h["word"].isin(words))
    some = F.col("t").rlike(any_word)
    keys = F.filter(F.array(*map(F.lit, sorted({k for _, k, _ in templates}))), lambda k: F.contains(F.col("t"), F.concat(F.lit(" "), k, F.lit(" "))))
    nothing = F.array().cast("array<struct<word:string,position:bigint>>")
    return t.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (_count(F.col("t")) - 1).cast("bigint").alias("n_words"),
        F.array_compact(F.array(*base)).alias("base"),
        F.when(some, hits).otherwise(nothing).alias("hits"),
        F.when(some, keys).otherwise(F.array().cast("array<string>")).alias("keys"),
    )


def scan(files: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each file."""
    known = stored(facts(files, templates, phrases), "license-facts")
    words = known.where("size(hits) > 0").select("row", F.explode("hits").alias("h")).select("row", "h.word", "h.position")
    postings = index(templates)
    # one row per word of the index that occurs, and no more
    in_files = words.groupBy("word").agg(F.count_distinct("row").alias("df")).collect()
    total = known.count()
    df = {r["word"]: r["df"] for r in in_files}
    idf = {w: float(round(math.log((total + 1) / (df.get(w, 0) + 0.5)), 6)) for w in postings}
    weights = [sum(idf[w] for w in notice.split() if w not in COMMON) for _, _, notice in templates]
    proposes = proposing(idf, templates, least)
    rows = [(w, t, p, idf[w], (t, p) in proposes) for w, own in postings.items() for t, p in own]
    table = files.sparkSession.createDataFrame(rows, "word string, template int, at bigint, idf double, proposes boolean")
    votes = (
        words.join(F.broadcast(table), "word")
        .groupBy("row", "template", (F.col("position") - F.col("at")).alias("offset"))
        .agg(F.sum("idf").alias("mass"), F.max("proposes").alias("proposed"))
        .where("proposed")
    )
    label = F.element_at(F.array(*[F.lit(x[0]) for x in templates]), F.col("template") + 1)
    key = F.element_at(F.array(*[F.lit(x[1]) for x in templates]), F.col("template") + 1)
    full = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("template") + 1)
    best = votes.groupBy("row", "template").agg(F.max("mass").alias("mass"))
    scores = best.select("row", label.alias("label"), key.alias("key"), F.least(F.col("mass") / full, F.lit(1.0)).alias("share"))
    kept = scores.join(known.select("row", "keys"), "row").where((F.col("share") >= least) & F.array_contains("keys", F.col("key")))
    more = kept.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("score"))
    out = known.select("row", "doc_id", "n_words", "base").join(more, "row", "left")
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.coalesce("more", F.array().cast("array<string>")))))
    places = F.aggregate("base", F.lit(0).cast("bigint"), lambda s, b: s + b["places"])
    return out.select(
        "doc_id",
        "n_words",
        places.alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
