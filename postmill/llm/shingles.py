"""Hashed word shingles and HyperMinHash registers of texts, in numpy, for one Arrow batch at a time."""

from __future__ import annotations

REGISTERS = 128
MANTISSA = 10
BANDS = 32
_M1, _M2, _P, _Q = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that are hashed at once.
SLAB = 500_000

_cache: dict = {}


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(32))


def _powers(n: int):
    """base^i and base^-i mod 2^64 for i < n."""
    import numpy as np

    if len(_cache.get("up", ())) < n:
        size = max(n, SLAB)
        base, inverse = _P, pow(_P, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _cache["up"], _cache["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _cache["up"][:n], _cache["down"][:n]


def word_hashes(data: bytes):
    """64-bit hashes of the words of data, A-Z lower-cased, and each word's first byte; words lie between ASCII white space."""
    import numpy as np

    b = np.frombuffer(data.lower(), np.uint8)
    blank = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _powers(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_Q)), starts


def shingle_sets(texts, size: int):
    """The sorted distinct shingle hashes of each text: of size words, or of all words where there are fewer."""
    slab, held = [], 0
    for text in texts:
        slab.append(text)
        held += len(text) + 1
        if held >= SLAB:
            yield from _slab_sets(slab, size)
            slab, held = [], 0
    if slab:
        yield from _slab_sets(slab, size)


def _slab_sets(slab: list[bytes], size: int):
    import numpy as np

    hashes, starts = word_hashes(b" ".join(slab))
    begins = np.cumsum([0] + [len(t) + 1 for t in slab])
    edges = np.searchsorted(starts, begins)
    rolled = hashes
    if size > 1 and len(hashes) >= size:
        rolled = hashes[: len(hashes) - size + 1] * np.uint64(_M2 | 1)
        for k in range(1, size):
            rolled = _mixed(rolled + np.uint64(_Q * k % 2**64)) * np.uint64(_M1) + hashes[k : len(hashes) - size + 1 + k]
        rolled = _mixed(rolled)
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        if z - a >= size:
            yield np.unique(rolled[a : z - size + 1])
        elif z > a:
            whole = np.full(1, z - a, np.uint64)
            for k in range(a, z):
                whole = _mixed(whole * np.uint64(_Q) + hashes[k : k + 1])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def _probes():
    """For each register, the others in an order of its own; an empty register borrows from the first that is not."""
    import numpy as np

    if "probes" not in _cache:
        keys = _mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS)
        _cache["probes"] = np.argsort(keys, axis=1)
    return _cache["probes"]


def registers(hashes):
    """HyperMinHash of a non-empty set: per bucket of the hashes the least one's leading zeros and MANTISSA bits after
    its first one. Buckets without a hash borrow another's register (densification), so small sets have all registers."""
    import numpy as np

    bits = REGISTERS.bit_length() - 1
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)  # sorted hashes: the first of a bucket is its least
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    rest = (hashes[first] << np.uint64(bits)) | np.uint64(1)
    zeros = (63 - np.floor(np.log2(rest.astype(np.float64)))).astype(np.int64)
    zeros = np.clip(zeros, 0, 62)
    body = ((rest << (zeros.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MANTISSA)).astype(np.int64)
    out = np.full(REGISTERS, -1, np.int64)
    out[at[first]] = (zeros << MANTISSA) | body
    empty = np.flatnonzero(out < 0)
    if len(empty):
        probes = _probes()[empty]
        out[empty] = out[probes[np.arange(len(empty)), np.argmax(out[probes] >= 0, axis=1)]]
    return out.astype(np.uint16)


def band_keys(all_registers):
    """One 64-bit key per row and band, of the band's registers and its number. all_registers: rows x REGISTERS."""
    import numpy as np

    grouped = all_registers.reshape(len(all_registers), BANDS, REGISTERS // BANDS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grouped.shape[:2]) + np.uint64(1)
    for k in range(grouped.shape[2]):
        key = _mixed(key * np.uint64(_Q) + grouped[:, :, k] + np.uint64(1))
    return key


def chance(n, m):
    """The probability that registers of disjoint sets of n and m shingles agree: both have the same leading zeros and,
    by chance, the same MANTISSA bits."""
    import numpy as np

    k = np.arange(1, 50, dtype=np.float64)
    n, m = np.atleast_1d(n).astype(np.float64)[:, None] / REGISTERS, np.atleast_1d(m).astype(np.float64)[:, None] / REGISTERS
    own, other = (np.exp(-x * 2.0**-k) - np.exp(-x * 2.0 ** -(k - 1)) for x in (n, m))
    return (own * other).sum(1) * 2.0**-MANTISSA


def estimated(a, b, n, m):
    """Jaccard estimate of registers a and b (rows x REGISTERS) of sets of n and m shingles, corrected for chance."""
    import numpy as np

    c = np.clip(chance(n, m), 0, 0.5)
    return np.clip(((a == b).mean(1) - c) / (1 - c), 0, 1)
