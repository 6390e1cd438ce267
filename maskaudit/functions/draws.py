"""Random draws keyed by what they decide.

A draw is the leading hex digits of the md5 of its key, so it depends on nothing but the
seed, the purpose and the row's own key: not on partitioning, row order or other draws.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_HEX_DIGITS = 15
DRAW_RANGE = 16**DRAW_HEX_DIGITS


def draw_key(seed: int, purpose: str, *keys: Column) -> Column:
    """Return the text a draw is keyed by: ``seed|purpose|key|...``."""
    return F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys])


def draw(seed: int, purpose: str, *keys: Column) -> Column:
    """Return a uniform BIGINT in ``[0, 2**60)``."""
    digits = F.substring(F.md5(draw_key(seed, purpose, *keys)), 1, DRAW_HEX_DIGITS)
    # Never NULL: a nullable draw used as a join key would be computed once more for a NULL filter.
    return F.coalesce(F.conv(digits, 16, 10).cast("bigint"), F.lit(0))


def draw_int(seed: int, purpose: str, n: Column | int, *keys: Column) -> Column:
    """Return a uniform BIGINT in ``[0, n)``; the modulo bias is below ``n / 2**60``."""
    bound = F.lit(n) if isinstance(n, int) else n
    return F.coalesce(F.pmod(draw(seed, purpose, *keys), bound.cast("bigint")), F.lit(0))


def draw_unit(seed: int, purpose: str, *keys: Column) -> Column:
    """Return a uniform DOUBLE in ``[0, 1)``."""
    return draw(seed, purpose, *keys).cast("double") / F.lit(float(DRAW_RANGE))


def derived_seed(seed: int, *keys: Column) -> Column:
    """Return a 32-bit seed of its own for every combination of keys."""
    digits = F.substring(F.md5(draw_key(seed, "seed", *keys)), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint")


TILE = 1 << 14  # keys whose md5 is worked out together
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
MD5_TURN = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
MD5_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def _md5_start(words: list[int | np.ndarray], shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Return the first two words of the md5 of messages of one block, whose 16 words are numbers or arrays."""
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in MD5_START)
    f, t = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for i in range(64):
        if i < 16:  # (b & c) | (~b & d)
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # (d & b) | (~d & c)
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[MD5_WORD[i]]
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            word = 0
        np.add(f, a, out=f)
        np.add(f, np.uint32((MD5_ADD[i] + word) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(MD5_TURN[i]), out=t)
        np.right_shift(f, np.uint32(32 - MD5_TURN[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(MD5_START[0]), b + np.uint32(MD5_START[1])


def _same_length(start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """Cut a range into (begin, end, digits of its numbers)."""
    while start < stop:
        digits = len(str(start))
        end = min(stop, 10**digits)
        yield start, end, digits
        start = end


def _written(numbers: np.ndarray, digits: int, at: int) -> dict[int, np.ndarray]:
    """Return what the decimal digits of ``numbers``, the first one at byte ``at``, add to the words of a message."""
    words: dict[int, np.ndarray] = {}
    for k in range(digits):
        digit = (numbers // 10 ** (digits - 1 - k) % 10 + 48).astype(np.uint32) << np.uint32(8 * ((at + k) % 4))
        words[(at + k) // 4] = words.get((at + k) // 4, np.uint32(0)) | digit
    return words


def draw_table(seed: int, purpose: str, rows: range, columns: range) -> np.ndarray:
    """Return ``draw(seed, purpose, r, j)`` for every number r of ``rows`` and j of ``columns`` (steps of 1), as uint64."""
    out = np.empty((len(rows), len(columns)), dtype=np.uint64)
    head = f"{seed}|{purpose}|".encode()
    for r0, r1, r_digits in _same_length(rows.start, rows.stop):
        for j0, j1, j_digits in _same_length(columns.start, columns.stop):
            size = len(head) + r_digits + 1 + j_digits
            if size > 55:  # the message needs a second block
                for r in range(r0, r1):
                    texts = (b"%s%d|%d" % (head, r, j) for j in range(j0, j1))
                    digests = b"".join(hashlib.md5(x, usedforsecurity=False).digest()[:8] for x in texts)
                    out[r - rows.start, j0 - columns.start : j1 - columns.start] = np.frombuffer(digests, dtype=">u8")
                continue
            text = head + bytes(r_digits) + b"|" + bytes(j_digits) + b"\x80"
            fixed = np.frombuffer(text.ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), dtype="<u4").tolist()
            for j in range(j0, j1, TILE):
                j_end = min(j + TILE, j1)
                j_words = _written(np.arange(j, j_end)[None, :], j_digits, len(head) + r_digits + 1)
                step = max(1, TILE // (j_end - j))
                for r in range(r0, r1, step):
                    r_end = min(r + step, r1)
                    r_words = _written(np.arange(r, r_end)[:, None], r_digits, len(head))
                    words: list[int | np.ndarray] = list(fixed)
                    for part in (r_words, j_words):
                        for k, word in part.items():
                            words[k] = word | (np.uint32(words[k]) if isinstance(words[k], int) else words[k])
                    a, b = _md5_start(words, (r_end - r, j_end - j))
                    digest = (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()
                    out[r - rows.start : r_end - rows.start, j - columns.start : j_end - columns.start] = digest
    out >>= np.uint64(64 - 4 * DRAW_HEX_DIGITS)
    return out
