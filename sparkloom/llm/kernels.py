"""Vectorised text kernels for Arrow batches: no loop runs per character or per word.

Texts are joined into one code-point array per chunk (about a million characters, so
temporaries stay in cache) and every step is a numpy pass over that array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHUNK = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of the result are usable."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def points(text: str) -> np.ndarray:
    """Unicode code points of a string."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: list[str], context: int, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield ``(points, rows, lengths)`` chunks covering every text wholly.

    Each piece of a text is preceded by ``context`` points: zeros at the start of the
    text, otherwise the points just before it, so that windows never lose a position
    where a long text is divided.
    """
    buf, rows, lens, n, pad = [], [], [], 0, "\0" * context
    for row, t in enumerate(texts):
        for at in range(0, len(t), size):
            part = t[at : at + size]
            buf.append((pad if at == 0 else (pad + t[max(0, at - context) : at])[-context:] if context else "") + part)
            rows.append(row)
            lens.append(len(part))
            n += len(part) + context
            if n >= size:
                yield points("".join(buf)), np.array(rows), np.array(lens)
                buf, rows, lens, n = [], [], [], 0
    if buf:
        yield points("".join(buf)), np.array(rows), np.array(lens)


LOW = 3328  # code points below are symbols as they are


def spelled(text: str) -> str:
    """The text in symbols below 4096: a code point from ``LOW`` up becomes two symbols, or
    three beyond the basic plane, of ranges of their own, so that no two texts agree that
    differ."""
    if text.isascii():
        return text
    c = points(text)
    if not (c >= LOW).any():
        return text
    n = 1 + (c >= LOW) + (c > 0xFFFF)
    out, at = np.repeat(c, n), np.cumsum(n) - n
    two, three = n == 2, n == 3
    out[at[two]], out[at[two] + 1] = LOW + (c[two] >> 8), LOW + 256 + (c[two] & 255)
    out[at[three]], out[at[three] + 1], out[at[three] + 2] = LOW + 512 + (c[three] >> 16), LOW + (c[three] >> 8 & 255), LOW + 256 + (c[three] & 255)
    return out.astype(np.uint32).tobytes().decode("utf-32-le")


def codes(cps: np.ndarray, order: int) -> np.ndarray:
    """Packed ``order``-grams of symbols below 4096, 12 bits each. Entry i covers symbols
    i .. i+order-1."""
    c = cps.astype(U)
    n = len(c) - order + 1
    out = c[:n].copy()
    for k in range(1, order):
        out <<= U(12)
        out |= c[k : n + k]
    return out


def starts(lens: np.ndarray, context: int) -> np.ndarray:
    """First window of each piece, for windows of ``context + 1`` points."""
    return np.concatenate([[0], np.cumsum(lens + context)[:-1]]).astype(np.int64)


def inside(lens: np.ndarray, context: int, total: int) -> np.ndarray:
    """Mask of the windows that end within a piece (not in its leading context)."""
    delta = np.zeros(total + 1, np.int8)
    s = starts(lens, context)
    delta[s] += 1
    np.subtract.at(delta, np.minimum(s + lens, total), 1)
    return np.cumsum(delta[:-1], dtype=np.int8).astype(bool)


def segment_sum(x: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of x over [first, first+len) for disjoint ascending segments."""
    c = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return c[first + lens] - c[first]


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their (summed) counts."""
    if not len(keys):
        return keys.astype(U), np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.diff(np.append(at, len(keys)))
    o = np.argsort(keys, kind="stable")
    keys, counts = keys[o], counts[o]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class HashArray:
    """Values by 64-bit key in arrays sorted by the keys' hashes, with a directory by the
    hashes' leading bits, so that a lookup touches about one entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mix(keys)
        o = np.argsort(h)
        self.h, self.v = h[o], values[o]
        bits = max(1, int(np.ceil(np.log2(len(h) + 1))) + 1)
        self.shift = U(64 - bits)
        self.dir = np.searchsorted(self.h >> self.shift, np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)
        self.h = np.append(self.h, U(0xFFFFFFFFFFFFFFFF))
        self.v = np.append(self.v, values.dtype.type(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        h = mix(keys)
        at = self.dir[(h >> self.shift).astype(np.int64)]
        got = self.h[at]
        out = np.where((got == h) & (at < len(self.h) - 1), at, -1)
        left = np.flatnonzero(got < h)
        while len(left):
            at[left] += 1
            got, want = self.h[at[left]], h[left]
            hit = (got == want) & (at[left] < len(self.h) - 1)
            out[left[hit]] = at[left[hit]]
            left = left[(got < want) & (at[left] < len(self.h) - 1)]
        return out


@lru_cache(1)
def _classes() -> np.ndarray:
    """0: no word character, 1: word character, 2: a word by itself (scripts without spaces)."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for m in re.finditer(r"\w+", every):
        out[m.start() : m.end()] = 1
    for a, b in ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000)):
        out[a:b][out[a:b] == 1] = 2
    return out


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, U), np.full(n, _INV, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def words(texts: list[str], stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """``(hash, row, start, end)`` of every word of every lower-cased text of the list.

    A word is a run of letters, digits and underscores, or one ideograph or kana; start
    and end are character positions in the text as given. Lower-casing that changes a
    text's length is done without (the text is then hashed as it is), so that positions
    stay true. For each length in ``stems`` follow the hashes of the words' first so
    many characters, 0 for words that have no more.
    """
    low = [l if len(l := t.lower()) == len(t) else t for t in texts]
    cps = points("\n".join(low))
    if not len(cps):
        z = np.zeros(0, np.int64)
        return (z.astype(U), z, z, z, *(z.astype(U) for _ in stems))
    off = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in low]))])
    kind = _classes()[cps]
    isw = kind > 0
    prev = np.concatenate([[0], kind[:-1]])
    begin = np.flatnonzero(isw & ((prev == 0) | (kind == 2) | (prev == 2)))
    nxt = np.concatenate([kind[1:], [0]])
    end = np.flatnonzero(isw & ((nxt == 0) | (kind == 2) | (nxt == 2))) + 1
    size = 1 << max(10, int(len(cps)).bit_length())
    up, down = _powers(size)
    c = cps.astype(U)
    c += U(1)
    c *= U(0xD6E8FEB86659FD93)
    c ^= c >> U(29)
    c *= up[: len(c)]
    pre = np.concatenate([np.zeros(1, U), np.cumsum(c, dtype=U)])
    h = mix((pre[end] - pre[begin]) * down[begin])
    row = np.searchsorted(off, begin, side="right") - 1
    more = []
    for n in stems:
        x = mix((pre[np.minimum(begin + n, end)] - pre[begin]) * down[begin] + U(n))
        x[end - begin <= n] = 0
        more.append(x)
    return (h, row, begin - off[row], end - off[row], *more)


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, row, index of first word)`` of every n-gram of words within a row; a row
    of fewer words has one gram of all of them."""
    if not len(h):
        return h, row, row
    g = h.copy()
    last = row.copy()
    m = len(h)
    for k in range(1, n):
        g *= U(0xC2B2AE3D27D4EB4F)
        g[: m - k] += h[k:]
        last = np.concatenate([row[k:], np.full(min(k, m), -1)])
    full = last == row if n > 1 else np.ones(m, bool)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    keep = np.flatnonzero(full | (first & ~full))
    short = keep[~full[keep]]
    if len(short):
        ends = np.searchsorted(row, row[short], side="right")
        for s, e in zip(short, ends):
            x = 0
            for v in h[s:e].tolist():
                x = (x * 0xC2B2AE3D27D4EB4F + v + 1) % (1 << 64)
            g[s] = x
    return mix(g[keep]), row[keep], keep


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts of about ``size`` characters, with the first one's index;
    a text is never divided."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield at, texts[at : i + 1]
            at, n = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def column(batch, name: str) -> list:
    """A column of an Arrow batch as Python objects."""
    return batch.column(name).to_pylist()
