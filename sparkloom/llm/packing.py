"""Order-preserving packing of documents into windows by dynamic programming.

Documents lie one after another in id order, divided into shards by the characters
before them. Windows of at most ``window`` tokens are cut at document or sentence ends so
that padding plus the penalties for cutting inside a document are least. With P the tokens before a boundary,

    cost(j) = min over i with P(j) - P(i) <= window of
              cost(i) + window - (P(j) - P(i)) + penalty(j)

and cost(i) + P(i) is kept in a queue of rising values, so that a shard costs time
linear in its boundaries.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shards
from .kernels import _classes, points
from .scratch import pick, table

#: Where a token ends and the next may begin a sentence.
SENTENCE = re.compile(r"[.!?]+[\"'”»)\]]*\s+|[。！？]+[\"'”»)\]」』]*\s*|\n\s*")
STOPS = np.array([ord(c) for c in "、。！？「」『』"], np.uint32)


@lru_cache(1)
def _blank() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x3001) if chr(c).isspace()]] = True
    return out


@dataclass(frozen=True)
class Pack:
    """``window``: tokens a window (a token is a run without white space, or one ideograph,
    kana or their punctuation); ``cut``: penalty, in tokens, for a cut at a sentence end inside a document;
    ``hard``: for a cut inside a sentence, which only sentences longer than a window get;
    ``shard``: characters of consecutive documents that are packed together, whose last
    window alone is padded by the shard's end; ``spread``: repeats of a row lie as far
    apart as the whole, the second ones after all first ones, instead of side by side."""

    window: int = 2048
    cut: int = 64
    hard: int = 512
    shard: int = 6_000_000
    spread: bool = False


def boundaries(text: str, p: Pack) -> tuple[list[int], list[int], list[int]]:
    """``(tokens, characters, penalty)`` at each possible cut, the document's end last."""
    cps = points(text)
    blank = _blank()[cps]
    own = np.zeros(len(cps), bool) if text.isascii() else (_classes()[cps] == 2) | np.isin(cps, STOPS)
    edge = blank | own
    start = np.flatnonzero(~blank & (own | np.concatenate([[True], edge[:-1]])))
    if not len(start):
        return [], [], []
    stop = np.flatnonzero(~blank & (own | np.concatenate([edge[1:], [True]]))) + 1
    ends = np.array([m.end() for m in SENTENCE.finditer(text)], np.int64)
    n = np.unique(np.append(np.searchsorted(stop, ends, side="right"), len(stop)))
    n = n[n > 0]
    tokens, penalty, at = [], [], 0
    for e in n.tolist():
        while e - at > p.window:  # a sentence longer than a window
            at += p.window
            tokens.append(at)
            penalty.append(p.hard)
        if e > at:
            tokens.append(e)
            penalty.append(p.cut)
        at = e
    penalty[-1] = 0
    # a cut lies just before the next token, so that white space stays with what it follows
    first = np.append(start[1:], len(text))
    return tokens, first[np.array(tokens) - 1].tolist(), penalty


def cuts(total: list[int], penalty: list[int], p: Pack) -> list[int]:
    """Indices of the boundaries at which windows end, for cumulated tokens ``total``.

    Of solutions of equal cost, the one whose last windows start latest is taken.
    """
    n = len(total)
    P = [0, *total]
    cost, back = [0] * (n + 1), [0] * (n + 1)
    queue: deque[int] = deque([0])
    for j in range(1, n + 1):
        while P[j] - P[queue[0]] > p.window:
            queue.popleft()
        i = queue[0]
        cost[j] = cost[i] + p.window - (P[j] - P[i]) + penalty[j - 1]
        back[j] = i
        value = cost[j] + P[j]
        while queue and cost[queue[-1]] + P[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    out, j = [], n
    while j > 0:
        out.append(j - 1)
        j = back[j]
    return out[::-1]


def pack_shard(ids: list[int], texts: list[str], p: Pack) -> list[tuple[str, list[int], list[str], int, int]]:
    """``(text, ids, spans, tokens, padding)`` of a shard's windows, in order."""
    total, penalty, owner, char, base = [], [], [], [], 0
    for k, t in enumerate(texts):
        n, c, pen = boundaries(t, p)
        total += [base + x for x in n]
        penalty += pen
        owner += [k] * len(n)
        char += c
        base += n[-1] if n else 0
    out, doc, at, before = [], 0, 0, 0
    held = [k for k in dict.fromkeys(owner)]
    step = {a: b for a, b in zip(held, held[1:])}
    doc = held[0] if held else 0
    for j in cuts(total, penalty, p):
        spans = []
        while True:
            stop = char[j] if owner[j] == doc else len(texts[doc])
            if stop > at:
                spans.append((doc, at, stop))
            if owner[j] == doc:
                at = stop
                if at == len(texts[doc]) and doc in step:
                    doc, at = step[doc], 0
                break
            doc, at = step[doc], 0
        out.append(("\n\n".join(texts[d][a:b] for d, a, b in spans), [ids[d] for d, _, _ in spans], [f"{a}-{b}" for _, a, b in spans], total[j] - before, p.window - (total[j] - before)))
        before = total[j]
    return out


def _begins(keys: DataFrame, p: Pack) -> str:
    """The sorted keys ``(turn, doc_id, h)`` of the first row of every shard but the first,
    from all rows' ``(turn, doc_id, h, size)``.

    Keys are sorted by range, and each partition sums its sizes; with the sums of those
    before it (one number a partition), every row knows the characters before it."""

    def run(batches):
        part, before, last = TaskContext.get().partitionId(), 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            ends = before + np.cumsum(b.column("size").to_numpy().astype(np.int64))
            lo = np.concatenate([[before], ends[:-1]])
            prev = np.concatenate([[last], lo[:-1]])
            before, last = int(ends[-1]), int(lo[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(len(lo), part, np.int32)), pa.array(lo), pa.array(prev), pa.array(ends)], ["turn", "doc_id", "h", "part", "lo", "prev", "hi"])

    order = ["turn", "doc_id", "h"]
    rows = keys.select(*order, "size").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = table(rows.mapInArrow(run, "turn long, doc_id long, h long, part int, lo long, prev long, hi long"), "order")
    parts, at, last = [], 0, 0
    for r in rows.groupBy("part").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("part").collect():  # a row a partition
        parts.append((r.part, at, last))
        at, last = at + r.hi, at + r.lo
    known = F.broadcast(keys.sparkSession.createDataFrame(parts, "part int, base long, before long"))
    here = F.col("lo") + F.col("base")
    before = F.when(F.col("prev") < 0, F.col("before")).otherwise(F.col("prev") + F.col("base"))
    return shards.write_order(rows.join(known, "part").filter(F.floor(here / p.shard) != F.floor(before / p.shard)).select(*order))


def shard_of(turn: np.ndarray, ids: np.ndarray, h: np.ndarray, begins: tuple[np.ndarray, ...], seen: int) -> np.ndarray:
    """Shard of each key: the number of ``begins`` that are not after it. Of shards that
    begin with the very same key (equal rows that fill several), rows take turns, ``seen``
    being the rows before these."""
    out = np.zeros(len(ids), np.int64)
    for t in np.unique(turn).tolist():
        x, y = np.searchsorted(begins[0], t, "left"), np.searchsorted(begins[0], t, "right")
        a, b = begins[1][x:y], begins[2][x:y]
        own = np.flatnonzero(turn == t)
        lo, hi = np.searchsorted(a, ids[own], "left"), np.searchsorted(a, ids[own], "right")
        out[own] = x + hi
        for k in np.flatnonzero(hi > lo).tolist():
            i, part = own[k], b[lo[k] : hi[k]]
            first, end = np.searchsorted(part, h[i], "left"), np.searchsorted(part, h[i], "right")
            out[i] = x + lo[k] + (end if end - first < 2 else first + 1 + (seen + i) % (end - first))
    return out


def packed(docs: DataFrame, p: Pack = Pack()) -> DataFrame:
    """``shard, window, doc_ids, spans, text, tokens, padding`` of all windows.

    ``spans`` are the characters taken of each document, ``text`` those passages joined
    by an empty line. Every word of every document with an id is in exactly one window,
    in order of id (of any sign and spacing), then of the text's hash. Null, empty and
    blank texts take no room and are in no window, nor are rows without an id. A repeated
    row is packed each time. A sentence longer than a window is cut at the window's
    length, and a text longer than a shard is a shard by itself. Other columns are left
    aside. An empty table gives an empty result.
    """
    d = pick(docs, doc_id="long", text="string").filter(r"doc_id is not null and text rlike '\\S'").withColumn("h", F.xxhash64("text"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("h")) - 1 if p.spread else F.lit(0)
    d = d.select(turn.cast("long").alias("turn"), "doc_id", "h", "text")
    if p.spread:
        d = table(d, "turns")
    made = _begins(d.select("turn", "doc_id", "h", F.length("text").alias("size")), p)

    def place(batches):
        begins, seen = shards.opened_order(made), 0
        for b in batches:
            if b.num_rows:
                at = shard_of(*(b.column(c).to_numpy() for c in ("turn", "doc_id", "h")), begins, seen)
                seen += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], ["shard", "turn", "doc_id", "h", "text"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id", "h"], kind="stable")
        rows = pack_shard(pdf.doc_id.tolist(), pdf.text.tolist(), p)
        out = pd.DataFrame(rows, columns=["text", "doc_ids", "spans", "tokens", "padding"])
        return out.assign(shard=key[0], window=range(len(out)))[["shard", "window", "doc_ids", "spans", "text", "tokens", "padding"]]

    schema = "shard long, window int, doc_ids array<long>, spans array<string>, text string, tokens int, padding int"
    return d.mapInArrow(place, "shard long, turn long, doc_id long, h long, text string").groupBy("shard").applyInPandas(run, schema)
