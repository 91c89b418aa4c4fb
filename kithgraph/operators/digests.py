"""MD5 of many short texts with the same beginning."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Texts that are hashed at once, so that the words stay in a core's cache.
CHUNK = 8_192
_SHIFTS = [s for group in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in group * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476


def _endings(numbers: np.ndarray, shift: int) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """For each length of the decimal numbers: where these are, their length, and a column of words for each four bytes that they take from byte ``shift`` on, with the bit that ends a text."""
    texts = numbers.astype("S20")
    sizes = np.char.str_len(texts)
    out = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        block = np.zeros((len(at), -(-(shift + int(size) + 1) // 4) * 4), np.uint8)
        block[:, shift : shift + size] = texts[at].view(np.uint8).reshape(len(at), -1)[:, :size]
        block[:, shift + size] = 0x80
        out.append((at, int(size), np.ascontiguousarray(block.view("<u4").T)))
    return out


def first_words(head: bytes, numbers: np.ndarray, kept: dict[int, list]) -> np.ndarray:
    """The first four bytes, as a number that sorts as they do, of the MD5 of ``head`` and each number in decimal. ``kept`` has what doesn't depend on the head, for the same numbers."""
    shift, whole = len(head) % 4, len(head) // 4
    if len(head) > 34:  # the text might not fit in one block
        return np.array([int.from_bytes(hashlib.md5(head + str(x).encode()).digest()[:4], "big") for x in numbers.tolist()], np.uint32)
    if shift not in kept:
        kept[shift] = _endings(numbers, shift)
    start = [int(x) for x in np.frombuffer(head + b"\0" * (-len(head) % 4), "<u4")]
    out = np.empty(len(numbers), np.uint32)
    for at, size, ending in kept[shift]:
        found = np.empty(len(at), np.uint32)
        for k in range(0, len(at), CHUNK):
            words: list[int | np.ndarray] = [*start[:whole], *ending[:, k : k + CHUNK]]
            if shift:
                words[whole] = words[whole] | np.uint32(start[whole])
            words += [0] * (16 - len(words))
            words[14] = 8 * (len(head) + size)
            found[k : k + CHUNK] = _first_word(words, min(CHUNK, len(at) - k))
        out[at] = found
    return out.byteswap()


def _first_word(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """The first word of the state after one block."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the last three steps don't change the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        if isinstance(words[g], np.ndarray):
            f += words[g]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((words[g] + _SINES[i]) & 0xFFFFFFFF)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        f <<= np.uint32(_SHIFTS[i])
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return b + np.uint32(_START[0])
