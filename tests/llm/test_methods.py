"""What the methods of licences and quality add, against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
import regex

from postmill.llm import licenses, quality
from postmill.llm.common import read


def words_of(text):
    return [w for w in re.split(licenses.BREAK, "".join(c.lower() if c.isascii() else c for c in text or "")) if w]


def brute_labels(texts):
    """Labels and score of each text: every template at every offset, without index or proposals."""
    lists = [words_of(t) for t in texts]
    vocabulary = {w for _, _, n in licenses.TEMPLATES for w in n.split() if w not in licenses.COMMON}
    df = Counter(w for own in lists for w in vocabulary & set(own))
    idf = {w: round(math.log((len(lists) + 1) / (df[w] + 0.5)), 6) for w in vocabulary}
    holds = lambda own, phrase: any(own[i : i + len(phrase)] == phrase for i in range(len(own) - len(phrase) + 1))
    out = []
    for own in lists:
        labels, score = {label for phrase, label in licenses.PHRASES if holds(own, phrase.split())}, 0.0
        for label, key, notice in licenses.TEMPLATES:
            told = notice.split()
            total = sum(idf[w] for w in told if w not in licenses.COMMON)
            best = max((sum(idf[w] for p, w in enumerate(told) if w not in licenses.COMMON and 0 <= o + p < len(own) and own[o + p] == w) for o in range(-len(told), len(own))), default=0.0)
            share = min(best / total, 1.0)
            if share >= licenses.LEAST and holds(own, key.split()):
                labels.add(label)
                score = max(score, share)
        out.append((",".join(sorted(labels)), score))
    return out


def test_license_labels_and_scores_against_brute_force(spark, odd_docs):
    draw = random.Random(3)
    notices = [n for _, _, n in licenses.TEMPLATES]
    texts = [r["text"] for r in odd_docs.collect() if len(r["text"] or "") < 1000]
    for _ in range(250):
        own = draw.choice(notices).split()
        # words dropped, changed or put in between
        own = [w for w in own if draw.random() > 0.12]
        own = [x for w in own for x in ((w, "word") if draw.random() < 0.05 else (w,))]
        texts.append(" ".join(draw.choices(["some", "license", "text", "the", "public", "of"], k=draw.randint(0, 8)) + own + draw.choices(notices, k=draw.random() < 0.2)))
    texts += ["MIT License", "// SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-3.0-only", "BSD 3-Clause License", "# the Unlicense", "a license for the public", "Mozilla Public License Version 2.0"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)).collect()}
    want = brute_labels(texts)
    for i, (labels, score) in enumerate(want):
        assert got[i] == (labels, pytest.approx(score, abs=1e-9)), texts[i]
    assert [got[len(texts) - 7 + i][0] for i in range(7)] == ["mit", "apache-2.0", "gpl", "bsd", "unlicense", "", "mpl-2.0"]


def brute_features(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    n, chars = max(len(words), 1), max(len(text), 1)
    kept = lambda p: len(regex.findall(p, text))
    return [
        min(math.log1p(len(text)) / 12, 1),
        min(chars / n / 20, 1),
        kept(r"\p{Lu}") / chars,
        kept("[0-9]") / chars,
        min(kept(r"[#$%&*@^~<>=+_\\{}\[\]]") / n, 3) / 3,
        min(text.count("|") / n, 1),
        min((text.count("!") + text.count("?")) / n, 2) / 2,
        len(set(words)) / n**0.8 / 4,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(len(w) <= 3 for w in words) / n,
        min(text.count("\n") / n, 1),
    ]


def test_quality_scores_against_plain_python(spark, sf, odd_docs):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    model = quality.learn(docs, read(spark, sf, "labels"))
    rows = docs.unionByName(odd_docs.select("doc_id", "text"))
    accept = quality.ACCEPT
    shift = model["cut"] - math.log(accept / (1 - accept))

    def want(text):
        x = brute_features(text or "")
        z = sum(w * (v - m) / s for w, v, m, s in zip(model["weights"], x, model["mean"], model["spread"], strict=True))
        return 1 / (1 + math.exp(-(z - shift)))

    for r in quality.score(rows, model).collect():
        assert r["score"] == pytest.approx(want(r["text"]), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= accept)


def test_quality_weights_are_the_best_of_their_pairs(spark, sf):
    """The learnt weights leave no slope of the penalised pairwise loss, drawn again from the same labelled rows."""
    import numpy as np

    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = quality.learn(docs.select("doc_id", "text"), labels)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out(docs["doc_id"]).alias("h")).collect()}
    x = [(marks[r["doc_id"]], brute_features(r["text"] or "")) for r in docs.collect() if marks.get(r["doc_id"]) in (0, 1) and not held[r["doc_id"]]]
    z = (np.array([v for _, v in x]) - model["mean"]) / model["spread"]
    y, w = np.array([m for m, _ in x]), np.array(model["weights"])
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, len(w))
    loss = lambda u: np.log1p(np.exp(-np.clip(d @ u, -500, 500))).mean() + 5e-4 * u @ u
    # all pairs against the drawn ones: no step along an axis gains more than their difference can explain
    steps = [loss(w + s * e) - loss(w) for e in np.eye(len(w)) for s in (-1.0, 1.0)]
    assert min(steps) > -0.005


def test_only_nodes_of_shared_buckets_meet(spark):
    """A block of 100 outside nodes that shares a bucket with each of 50 small blocks by one node sends them that node only."""
    from postmill.llm import neardup

    hot = [(0, n, 1, n, n > 0) for n in range(101)]
    small = [(k, n, 100 + k, n, out) for k in range(1, 51) for n, out in ((k, True), (1000 + k, False))]
    still = spark.createDataFrame([(k, n, b if n >= 1000 else 1, c, o) for k, n, b, c, o in hot + small], "key long, node long, block long, component long, outside boolean")
    asks = still.where("outside").selectExpr("key", "node", "component AS own", "7L AS rest")
    ours, theirs = (sorted((r["rest"], r["block"], r["node"], r["component"], r["side"]) for r in x.collect()) for x in neardup._meeting(still, asks))
    assert ours == sorted([(7, 1, n, n, 0) for n in range(1, 101)] + [(7, 100 + k, k, k, 0) for k in range(1, 51)])
    assert theirs == sorted([(7, 1, n, n, 1) for n in range(101)] + [(7, 100 + k, 1000 + k, 1000 + k, 1) for k in range(1, 51)])
