"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to every source in which its text occurs. Distinct texts are
aggregated by that set of sources (their membership pattern); a flow routes the
patterns' token capacity to the sources' quotas, where the r-th use of a token costs
more than the one before. The patterns' documents, in a seeded order, then fill the
routed amounts.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import col, fresh, pick, table

NONE = ""


@dataclass(frozen=True)
class Mix:
    """``weights``: share of each source (need not sum to 1); without them a source's
    share is its size to the power ``temperature``. ``budget``: total tokens; the tokens
    of all distinct texts if None. ``repeats``: uses of one text at most; quotas that
    this cannot fill stay unfilled. ``seed``: of the documents' order. ``bits``: leading
    bits of the order by which sums are made in parallel; the result does not depend on
    them. ``several``: sign between the sources of a document that has more than one.
    """

    weights: dict[str, float] | None = field(default=None, hash=False)
    temperature: float = 0.7
    budget: int | None = None
    repeats: int = 8
    seed: int = 17
    bits: int = 10
    several: str | None = None


class Flow:
    """Max flow from patterns to sources (Dinic), kept while the patterns' capacities grow.

    All costs lie on the patterns' own arcs and the r-th layer of every pattern costs the
    same, less than layer r+1. Successive shortest paths therefore exhaust the layers one
    after another, so that a maximum flow after each growth is a min-cost flow.
    """

    def __init__(self, members: list[list[int]], quotas: list[int]):
        n, s = len(members), len(quotas)
        self.S, self.T = n + s, n + s + 1
        self.adj: list[list[int]] = [[] for _ in range(n + s + 2)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.supply = [self._arc(self.S, i, 0) for i in range(n)]
        self.links = [[(j, self._arc(i, n + j, 1 << 62)) for j in m] for i, m in enumerate(members)]
        for j, q in enumerate(quotas):
            self._arc(n + j, self.T, q)

    def _arc(self, u: int, v: int, c: int) -> int:
        self.to += [v, u]
        self.cap += [c, 0]
        self.adj[u].append(len(self.to) - 2)
        self.adj[v].append(len(self.to) - 1)
        return len(self.to) - 2

    def grow(self, add: list[int]) -> int:
        """Add capacity to the patterns and send what more can be sent."""
        for a, c in zip(self.supply, add):
            self.cap[a] += c
        sent = 0
        while True:
            level = {self.S: 0}
            queue = deque([self.S])
            while queue:
                u = queue.popleft()
                for a in self.adj[u]:
                    if self.cap[a] and self.to[a] not in level:
                        level[self.to[a]] = level[u] + 1
                        queue.append(self.to[a])
            if self.T not in level:
                return sent
            at = [0] * len(self.adj)
            while (got := self._push(level, at)) > 0:
                sent += got

    def _push(self, level: dict[int, int], at: list[int]) -> int:
        path: list[int] = []
        u = self.S
        while u != self.T:
            while at[u] < len(self.adj[u]):
                a = self.adj[u][at[u]]
                if self.cap[a] and level.get(self.to[a], -1) == level[u] + 1:
                    path.append(a)
                    u = self.to[a]
                    break
                at[u] += 1
            else:
                if not path:
                    return 0
                a = path.pop()
                u = self.to[a ^ 1]
                at[u] += 1
        amount = min(self.cap[a] for a in path)
        for a in path:
            self.cap[a] -= amount
            self.cap[a ^ 1] += amount
        return amount

    def routed(self) -> list[list[tuple[int, int]]]:
        """``(source, tokens)`` of every pattern."""
        return [[(j, self.cap[a ^ 1]) for j, a in m if self.cap[a ^ 1]] for m in self.links]


def quotas(sizes: dict[str, int], p: Mix, budget: int) -> dict[str, int]:
    """Whole tokens by source; the shares of sources that do not occur are void."""
    raw = {s: (p.weights.get(s, 0.0) if p.weights is not None else float(n) ** p.temperature) for s, n in sizes.items()}
    total = sum(raw.values())
    return {s: int(budget * w / total) if total else 0 for s, w in raw.items()}


def solve(patterns: dict[tuple[str, ...], int], p: Mix) -> dict[tuple[str, ...], list[tuple[str, int]]]:
    """Tokens that each membership pattern gives to each source."""
    sizes: dict[str, int] = {}
    for m, c in patterns.items():
        for s in m:
            sizes[s] = sizes.get(s, 0) + c
    keys, names = sorted(patterns), sorted(sizes)
    q = quotas(sizes, p, p.budget if p.budget is not None else sum(patterns.values()))
    flow = Flow([[names.index(s) for s in m] for m in keys], [q[s] for s in names])
    left = sum(q.values())
    for _ in range(p.repeats):
        left -= flow.grow([patterns[m] for m in keys])
        if not left:
            break
    return {m: [(names[j], f) for j, f in r] for m, r in zip(keys, flow.routed()) if r}


def units(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """``(doc_id, pattern, tokens, u)``, one row a distinct text: its least id, the sorted
    sources that have it, its whitespace-separated words and its place in the order."""
    d = pick(docs, doc_id="long", text="string", source="string")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    d = d.filter("doc_id is not null and text is not null").select(
        "doc_id", F.array(F.coalesce("source", F.lit(NONE))).alias("source") if p.several is None else F.split(F.coalesce("source", F.lit(NONE)), re.escape(p.several)).alias("source"), words.cast("long").alias("tokens"),
        F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"),
    )
    return d.filter("tokens > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source")))).alias("pattern")
    )


def selection(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """``doc_id, source, uses, tokens``: the documents that fill each source's quota.

    The routed amounts of a pattern divide the line on which its documents lie one after
    another in seeded order, again for every repetition; a document goes to the source
    in whose part its start lies, so that a quota is met to within one document. A text
    that several documents have is represented by the least id. Null and empty texts,
    and rows without an id, are never selected; a null source counts as the source "".
    Ties in the order are broken by id. Texts are read wholly, other columns left aside.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    u = table(units(docs, p).withColumn("u", F.xxhash64(F.lit(p.seed), "doc_id")), "units")
    sums = u.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()  # a row a pattern: sources' combinations, not documents
    capacity = {tuple(r.pattern): r.tokens for r in sums}
    parts = []
    for m, routed in solve(capacity, p).items():
        at = 0
        for s, f in routed:
            parts.append((list(m), s, at, at + f, capacity[m]))
            at += f
    plan = spark.createDataFrame(parts, "pattern array<string>, target string, lo long, hi long, cap long")
    u = u.withColumn("b", F.shiftright("u", 64 - p.bits))
    chunk = u.groupBy("pattern", "b").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.select("pattern", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("pattern", "b").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = u.join(chunk, ["pattern", "b"]).withColumn("at", F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    first = F.greatest(F.lit(0), F.ceil((F.col("lo") - F.col("at")) / F.col("cap")))
    last = F.ceil((F.col("hi") - F.col("at")) / F.col("cap")) - 1
    uses = (last - first + 1).cast("int")  # repetitions r with lo <= at + r * cap < hi
    return placed.join(plan, "pattern").select("doc_id", F.col("target").alias("source"), uses.alias("uses"), "tokens").filter("uses > 0")


def mixed(docs: DataFrame, p: Mix = Mix()) -> DataFrame:
    """The selected documents, each as many times as it is used, with its own columns;
    ``source`` is the source whose quota the row fills. Every row of a chosen id is
    taken, so an id should have one row. Null and empty texts and rows without an id go;
    an empty table gives an empty result."""
    names = docs.columns
    own = {c.lower(): c for c in names}
    key, target, uses = fresh(docs, "key", "target", "uses")
    chosen = table(selection(docs, p).select("doc_id", "source", "uses"), "selection").toDF(key, target, uses)
    if "source" not in own:
        chosen = chosen.groupBy(key).agg(F.first(target).alias(target), F.sum(uses).alias(uses))
    out = docs.join(chosen, col(own["doc_id"]).cast("long") == F.col(key)).withColumn(uses, F.explode(F.array_repeat(F.lit(1), F.col(uses))))
    return out.select(*[F.col(target).cast(docs.schema[c].dataType).alias(c) if c.lower() == "source" else col(c) for c in names])
