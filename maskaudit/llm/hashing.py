"""Word and shingle hashes of many texts at once, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Return the powers of BASE and of its inverse, as long as the longest chunk so far."""
    global _POWERS
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        out = []
        for base in (BASE, inverse):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS = (out[0], out[1])
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def word_hashes(texts: list[str | None], apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Return (hashes of all words of all texts in order, offsets of each text's words).

    Words are runs of bytes other than ``apart`` (SPACE: space and U+0009 to U+000D; MARKS: all of ASCII but letters
    and digits), with A-Z in lower case; equal words have equal hashes. A polynomial over random byte values, taken from prefix sums of the whole chunk, hashes every word without
    a Python step per word.
    """
    joined = "\n".join(t or "" for t in texts).encode("utf-8", "surrogatepass")
    raw = FOLD[np.frombuffer(joined, dtype=np.uint8)]
    lengths = [len((t or "").encode("utf-8", "surrogatepass")) if t and not t.isascii() else len(t or "") for t in texts]
    begins = np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)))
    inside = ~apart[raw]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    up, down = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(BYTE[raw] * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * ODD)
    return hashes, np.searchsorted(starts, begins[: len(texts) + 1])


def batches(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Yield (from, to) of runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        n = len(text or "") + 1
        if k > begin and size + n > limit:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def shingles(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Return (hashes of the n-word shingles of each text in order, offsets).

    A text of fewer than ``n`` words, but at least one, has its whole word sequence as its only shingle.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(out_offsets[-1]) - out_offsets[:-1][owner] + offsets[:-1][owner]
    length = np.minimum(counts, n)[owner]
    out = length.astype(np.uint64)
    for k in range(n):
        here = np.minimum(at + k, max(len(words) - 1, 0))
        step = mix(out * BASE + words[here]) if len(words) else out
        out = np.where(k < length, step, out)
    return out, out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return (each text's distinct values in ascending order, offsets)."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(len(offsets)))
