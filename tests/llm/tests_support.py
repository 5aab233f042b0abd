"""Brute-force helpers for the pipeline's tests."""

import re
from collections import Counter, defaultdict

import numpy as np

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def stripped_base(text):
    """The first base secret of a text, or None."""
    hits = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + list(re.finditer("AKIA[A-Z0-9]{16,}", text)) + list(re.finditer("[0-9a-f]{24,}", text))
    return hits[0] if hits else None


def components_of(texts, size):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def source_targets(docs, mixed):
    """(words taken, target, longest document) of each source."""
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    size, longest, taken = Counter(), Counter(), Counter()
    for r in docs:
        size[r["source"]] += count(r["text"])
        longest[r["source"]] = max(longest[r["source"]], count(r["text"]))
    for r in mixed:
        taken[r["source"]] += count(r["text"])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        open_ = sum(w[s] for s in names if s not in full)
        now = {s: 2 * size[s] if s in full else rest * w[s] / open_ for s in names}
        over = {s for s in names if s not in full and now[s] > 2 * size[s]}
        if not over:
            return [(taken[s], now[s], longest[s]) for s in names]
        full |= over


def packed_whole(pieces, docs, tokenizer):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    copies = Counter(r["doc_id"] for r in docs)
    texts = {r["doc_id"]: r["text"] for r in docs}
    starts, spans = defaultdict(Counter), defaultdict(list)
    for r in pieces:
        starts[r["doc_id"]][(r["start"], r["length"], r["doc_tokens"])] += 1
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        n = len(own.encode(t or "", add_special_tokens=False).ids) + 1
        want = Counter({(s, min(4096, n - s), n): copies[i] for s in range(0, n, 4096)})
        assert starts[i] == want
    for own_spans in spans.values():
        at = 0
        for offset, length in sorted(own_spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert np.mean([sum(n for _, n in x) for x in spans.values()]) > 0.9 * 4096
