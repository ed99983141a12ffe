"""Language ID by n-gram filters with language bitmasks.

One bit-sliced Bloom filter holds all languages: row r of the filter is a mask with one
bit a language, and the AND of the rows at an n-gram's hash positions is the set of all
languages that (perhaps) contain it. A document's n-grams are counted by language bit,
each count is corrected for its language's false-positive rate, and the largest decides.

Spark fills the filter from all n-grams of all documents; the rows lie in a file that
grows with the distinct n-grams and is mapped by the workers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import shards
from .quality import count_grams
from .scratch import append, pick, table

ORDER = 5
UNKNOWN = "und"


@dataclass(frozen=True)
class Filter:
    """``ratio``: a language contains an n-gram if its share of the language's n-grams is
    at least this part of the n-gram's largest share in any language, so that every
    n-gram is in some language, and the few that wrongly declared documents bring are
    not in theirs; ``bits``: filter rows an n-gram of the language of the most;
    ``hashes``: rows an n-gram sets; ``least``: share of a document's n-grams that the
    decided language must contain, after correction."""

    ratio: float = 0.05
    bits: int = 12
    hashes: int = 4
    least: float = 0.1


def places(keys: np.ndarray, rows: int, hashes: int) -> list[np.ndarray]:
    """Filter rows of each key."""
    h = K.mix(keys)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(rows)).astype(np.int64) for i in range(hashes)]


class SlicedBloom:
    """Rows of language masks: ``table[w, r]`` holds the bits of row r for languages
    ``w * bits`` to ``(w + 1) * bits - 1``, ``bits`` being the width of its entries.
    ``filled``: rows that each language has set."""

    def __init__(self, langs: list[str], table: np.ndarray, filled: list[int], hashes: int):
        self.langs, self.table, self.hashes = langs, table, hashes
        self.rows, self.bits = table.shape[1], table.dtype.itemsize * 8
        self.false = (np.array(filled, float) / self.rows) ** hashes

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """``[words, keys]``: the languages that contain each n-gram."""
        first, *more = places(keys, self.rows, self.hashes)
        out = self.table[:, first]
        for at in more:
            out &= self.table[:, at]
        return out

    def popcounts(self, keys: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """``[segments, languages]``: n-grams of each segment by language bit."""
        m = self.masks(keys)
        out = np.empty((len(first), len(self.langs)))
        for l in range(len(self.langs)):
            out[:, l] = K.segment_sum((m[l // self.bits] >> m.dtype.type(l % self.bits)) & m.dtype.type(1), first, lens)
        return out

    def corrected(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Expected numbers of n-grams truly contained: (count - f total) / (1 - f)."""
        return np.maximum(0, (counts - self.false * total[:, None]) / (1 - self.false))


def contained(docs: DataFrame, p: Filter) -> tuple[list[str], DataFrame]:
    """``(languages, (l, code))``: the n-grams that each declared language contains, from
    all of its documents."""
    known = docs.filter("lang is not null").select("lang", F.lower("text").alias("text"))
    grams = table(count_grams(known, "lang", "text"), "grams")
    totals = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    langs = sorted(totals)
    if not langs:
        return [], grams.select(F.lit(0).alias("l"), "code").limit(0)
    index = F.create_map(*[F.lit(x) for i, l in enumerate(langs) for x in (l, F.struct(F.lit(i).alias("l"), F.lit(float(totals[l])).alias("n")))])
    own = grams.withColumn("o", index[F.col("lang")]).select("code", F.struct(F.col("o.l").alias("l"), (F.col("n") / F.col("o.n")).alias("s")).alias("x"))
    every = own.groupBy("code").agg(F.collect_list("x").alias("x"), F.max("x.s").alias("most"))  # at most a struct a language
    return langs, every.select("code", F.explode(F.filter("x", lambda x: x["s"] >= p.ratio * F.col("most"))).alias("x")).select("x.l", "code")


def build(docs: DataFrame, p: Filter) -> tuple[list[str], str, list[int]]:
    """``(languages, folder of the filter's rows, rows that each language has set)``."""
    langs, grams = contained(docs, p)
    if not langs:
        return [], "", []
    grams = table(grams, "contained")
    sizes = {r.l: r.n for r in grams.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = max(64, max(sizes.values()) * p.bits)
    bits = next((b for b in (8, 16, 32) if len(langs) <= b), 64)

    def run(batches):
        for b in batches:
            l, at = b.column("l").to_numpy(), places(b.column("code").to_numpy().astype(np.uint64), rows, p.hashes)
            mask = (np.uint64(1) << (l % bits).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(l // bits, p.hashes).astype(np.int32)), pa.array(np.concatenate(at)), pa.array(np.tile(mask, p.hashes))], ["w", "at", "v"])

    entries = table(grams.mapInArrow(run, "w int, at long, v long").groupBy("w", "at").agg(F.bit_or("v").alias("v")), "filter")
    lit = [F.sum(((F.col("w") == l // bits) & (F.shiftrightunsigned("v", l % bits).bitwiseAND(1) == 1)).cast("long")) for l in range(len(langs))]
    return langs, shards.write_rows(entries, rows, -(-len(langs) // bits), bits), list(entries.agg(*lit).first())


def identify(docs: DataFrame, p: Filter = Filter()) -> DataFrame:
    """``doc_id, declared, lang, score, margin`` of every document.

    ``score`` is the corrected share of the document's n-grams that the language
    contains, ``margin`` its lead over the next one. Filters are learnt from the
    documents that declare a language; those that declare none are identified too. A
    text that is null or empty, or whose score is below ``least``, is ``und``; of
    languages with equal counts the first by name is taken. Texts are lower-cased and
    read wholly. Repeated rows give repeated rows; other columns are left aside. An empty
    table gives an empty result.
    """
    d = pick(docs, doc_id="long", lang="string", text="string")
    langs, made, filled = build(d, p)
    at = d.columns.index("text")

    def run(b):
        f = SlicedBloom(langs, shards.opened_rows(made) if made else np.zeros((1, 1), np.uint8), filled, p.hashes)
        texts = [K.spelled(t.lower()) if t else "" for t in b.column(at).to_pylist()]
        counts, total = np.zeros((len(texts), max(1, len(f.langs)))), np.array([float(len(t)) for t in texts])
        if f.langs:
            for cps, rows, lens in K.pieces(texts, ORDER - 1):
                np.add.at(counts, rows, f.popcounts(K.codes(cps, ORDER), K.starts(lens, ORDER - 1), lens))
            counts = f.corrected(counts, total)
        order = np.argsort(-counts, axis=1, kind="stable")
        share = np.take_along_axis(counts, order, 1) / np.maximum(total, 1)[:, None]
        lead = share[:, 0] - (share[:, 1] if share.shape[1] > 1 else 0)
        sure = share[:, 0] >= p.least
        names = [f.langs[i] if ok and f.langs else UNKNOWN for i, ok in zip(order[:, 0], sure)]
        return [pa.array(names, pa.string()), pa.array(share[:, 0]), pa.array(lead)]

    out = append(d, run, found="string", score="double", margin="double")
    return out.select("doc_id", F.col("lang").alias("declared"), F.col("found").alias("lang"), "score", "margin")
