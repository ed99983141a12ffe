"""Licence scan: winnowed fingerprints pick candidates, banded alignment reports them.

Word 3-grams of all licence templates are winnowed (Schleimer, Wilkerson, Aiken 2003)
into an inverted index of fingerprints. Every document is winnowed alike; where its
fingerprints meet a template's on about one diagonal, the words are aligned in a band
around it, and matches of enough of the template are reported with their spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .license_texts import TEMPLATES
from .scratch import pick


@dataclass(frozen=True)
class Scan:
    """``n``: words a gram; ``winnow``: grams of which the least is kept, so that every
    shared run of ``n + winnow - 1`` words is found; ``band``: words by which a match may
    stray from its diagonal, half the template's at most, and a hundredth of a long
    template's at least; ``cover``: least share of the template's words matched;
    ``hits``: least share of a template's fingerprints on about one diagonal for it to
    be aligned. A match of three quarters whose mismatches are spread evenly still
    shares about a sixth of them."""

    n: int = 3
    winnow: int = 2
    band: int = 8
    cover: float = 0.75
    hits: float = 0.08


def fingerprints(g: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Indices of the grams that are least in some window of their row (the last of
    equals); a row of fewer grams keeps its least."""
    if not len(g):
        return np.zeros(0, np.int64)
    at = np.arange(len(g))
    low, where = g.copy(), at.copy()
    for k in range(1, window):
        nxt = np.full_like(g, np.iinfo(g.dtype).max)
        nxt[:-k] = g[k:]
        same = np.zeros(len(g), bool)
        same[:-k] = row[k:] == row[:-k]
        take = same & (nxt <= low)
        low[take], where[take] = nxt[take], at[take] + k
    last = np.zeros(len(g), bool)  # windows that would run past the row's end
    if window > 1:
        last[-(window - 1) :] = True
        last[: -(window - 1)] = row[window - 1 :] != row[: -(window - 1)]
    first = np.concatenate([[True], row[1:] != row[:-1]])
    return np.unique(where[~last | first])


class Index:
    """Template words, and ``(template, gram position)`` by fingerprint."""

    def __init__(self, templates: dict[str, str], p: Scan):
        self.names = list(templates)
        h, row, _, _ = K.words([templates[n] for n in self.names])
        cut = np.searchsorted(row, np.arange(len(self.names) + 1))
        self.words = [h[a:b] for a, b in zip(cut, cut[1:])]
        g, grow, first = K.grams(h, row, p.n)
        keep = fingerprints(g, grow, p.winnow)
        by: dict[int, list[tuple[int, int]]] = {}
        self.prints = np.bincount(grow[keep], minlength=len(self.names)).tolist()
        for i in keep.tolist():
            by.setdefault(int(g[i]), []).append((int(grow[i]), int(first[i] - cut[grow[i]])))
        keys = np.array(sorted(by), np.uint64)
        self.posting = [by[int(k)] for k in keys]
        self.table = K.HashArray(keys, np.arange(len(keys), dtype=np.int64))


def align(doc: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """``(matched words, first, end)`` of the best local alignment of template against
    document words within ``band`` of the diagonal (document less template position).

    A match scores 2, a mismatch or gap -1; of equal scores the earliest end is taken.
    """
    width = 2 * band + 1
    best = (0, 0, 0, 0)
    score, hits, start = [0] * width, [0] * width, [-1] * width
    words = doc.tolist()
    for i, t in enumerate(template.tolist()):
        new_score, new_hits, new_start = [0] * width, [0] * width, [-1] * width
        for c in range(width):
            j = i + diagonal + c - band
            if not 0 <= j < len(words):
                continue
            same = words[j] == t
            s, h, b = (score[c], hits[c], start[c]) if score[c] > 0 else (0, 0, j)
            s, h = (s + 2, h + 1) if same else (s - 1, h)
            if c + 1 < width and score[c + 1] - 1 > s:
                s, h, b = score[c + 1] - 1, hits[c + 1], start[c + 1]
            if c and new_score[c - 1] - 1 > s:
                s, h, b = new_score[c - 1] - 1, new_hits[c - 1], new_start[c - 1]
            if s > 0:
                new_score[c], new_hits[c], new_start[c] = s, h, b
                if s > best[0]:
                    best = (s, h, b, j + 1)
        score, hits, start = new_score, new_hits, new_start
    return best[1:]


def find(texts: list[str], index: Index, p: Scan) -> list[tuple[int, str, float, int, int]]:
    """``(row, licence, coverage, start, end)`` in characters."""
    out = []
    for at, part in K.chunks(texts):
        h, row, begin, end = K.words(part)
        g, grow, first = K.grams(h, row, p.n)
        keep = fingerprints(g, grow, p.winnow)
        pos = index.table.find(g[keep])
        met = np.flatnonzero(pos >= 0)
        if not len(met):
            continue
        cut = np.searchsorted(row, np.arange(len(part) + 1))
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, k in zip(keep[met].tolist(), index.table.v[pos[met]].tolist()):
            r = int(grow[i])
            w = int(first[i] - cut[r])
            for t, o in index.posting[k]:
                by.setdefault((r, t), []).append((w - o, w))
        for (r, t), hits in by.items():
            hits.sort()
            size, a = len(index.words[t]), cut[r]
            band = min(max(p.band, size // 100), max(1, size // 2))
            if len(hits) < p.hits * index.prints[t]:
                continue
            groups: list[list[int]] = []  # diagonals that lie within one band
            for d, _ in hits:
                if not groups or d - groups[-1][0] > band:
                    groups.append([d])
                else:
                    groups[-1].append(d)
            found = []
            for ds in groups:
                if len(ds) < p.hits * index.prints[t]:
                    continue
                mid = ds[len(ds) // 2]
                span = band + (ds[-1] - ds[0] + 1) // 2
                lo = max(0, mid - span)
                local = h[a + lo : min(a + mid + size + span, cut[r + 1])]
                n, s, e = align(local, index.words[t], mid - lo, span)
                if n >= p.cover * size and not any(s + lo < y and x < e + lo for x, y in found):
                    found.append((s + lo, e + lo))
                    out.append((at + r, index.names[t], n, n / size, int(begin[a + s + lo]), int(end[a + e + lo - 1])))
    return _best(out)


def _best(found: list[tuple[int, str, int, float, int, int]]) -> list[tuple[int, str, float, int, int]]:
    """Of matches of one text that overlap, the one of the most words, then of the largest
    coverage, then the first by name."""
    kept: dict[int, list] = {}
    for r, name, n, cover, s, e in sorted(found, key=lambda m: (-m[2], -m[3], m[1])):
        own = kept.setdefault(r, [])
        if not any(s < y and x < e for _, _, _, x, y in own):
            own.append((r, name, cover, s, e))
    return [m for r in sorted(kept) for m in sorted(kept[r], key=lambda m: m[3])]


def scan(docs: DataFrame, p: Scan = Scan(), templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license, coverage, first, last``: one row for every match of a template
    in a document, with the share of the template's words matched and its characters.

    Words are compared without case and punctuation. Null and empty texts, and texts
    without a match, have no rows; texts are read wholly, and a template that occurs
    twice has two rows. Of overlapping matches the one of the most words is reported, of
    equal ones that which covers more, then the first by name. A template of fewer than ``n`` words is one gram. Repeated rows
    give repeated rows; a null id is passed on. An empty table gives an empty result.
    """
    d = pick(docs, doc_id="long", text="string")
    held = d.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES, p))

    def run(batches):
        for b in batches:
            ids = K.column(b, "doc_id")
            rows = find([t or "" for t in K.column(b, "text")], held.value, p)
            if rows:
                r, name, cover, s, e = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in r], pa.int64()), pa.array(name), pa.array(cover), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
                    ["doc_id", "license", "coverage", "first", "last"],
                )

    return d.mapInArrow(run, "doc_id long, license string, coverage double, first long, last long")
