"""Quality rules: perplexity bands of a modified Kneser-Ney character 5-gram model.

Spark counts the 5-grams of every document by language; all lower orders follow from
them as continuation counts, and the counts of counts set the three discounts of every
order (Chen and Goodman 1999). Characters from U+0D00 up are spelled in two or three
symbols each (:func:`kernels.spelled`), so that no two of them count as one. Probabilities are computed by joins and kept in arrays
sorted by hash in files, which grow with the corpus and are mapped into memory.
Documents whose log perplexity lies outside their language's band are rejected.
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
from .scratch import append, col, fresh, pick, table

ORDER = 5
NONE = "und"


@dataclass(frozen=True)
class Bands:
    """Parameters of the rule.

    ``floor``: n-grams rarer than this share of their language's characters are left to
    the lower orders; by default none is. ``low`` and ``high``: width of the band below
    and above the language's median log perplexity, in standard deviations. The
    deviation of a text of n characters is that between the language's documents and
    the sampling error of n characters together, both estimated robustly.
    """

    floor: float = 0.0
    low: float = 5.0
    high: float = 5.0


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``(lang, code, n)``: all 5-grams of all texts by language, each position once.

    Documents without a language are counted under ``und``; null and empty texts have no
    n-grams; texts of any length are counted wholly. An empty table gives no rows.
    """

    def count(batches):
        held: dict[str, list] = {}

        def fold(lang):
            k, n = zip(*held[lang])
            held[lang] = [K.tally(np.concatenate(k), np.concatenate(n))]

        for b in batches:
            langs, texts = K.column(b, "l"), K.column(b, "t")
            by: dict[str, list[str]] = {}
            for l, t in zip(langs, texts):
                if t:
                    by.setdefault(l, []).append(t)
            for l, ts in by.items():
                for cps, _, lens in K.pieces([K.spelled(t) for t in ts], ORDER - 1):
                    c = K.codes(cps, ORDER)
                    held.setdefault(l, []).append(K.tally(c[K.inside(lens, ORDER - 1, len(c))]))
                    if len(held[l]) > 12:
                        fold(l)
        for l in list(held):
            fold(l)
            k, n = held.pop(l)[0]
            for at in range(0, len(k), 200_000):
                part = k[at : at + 200_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([l] * len(part), pa.string()), pa.array(part.astype(np.int64)), pa.array(n[at : at + 200_000])],
                    ["lang", "code", "n"],
                )

    src = docs.select(F.coalesce(col(lang).cast("string"), F.lit(NONE)).alias("l"), col(text).cast("string").alias("t"))
    part = src.mapInArrow(count, "lang string, code long, n long")
    return part.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; 0.5, 1, 1.5 where the counts of counts are too few."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(v, 0.05), i - 0.05) for v, i in zip(d, (1, 2, 3)))


def build(grams: DataFrame, floor: float) -> tuple[str, dict[str, list]]:
    """``(path, models)``: the folder of the probabilities and context weights of all
    n-grams (see :class:`~sparkloom.llm.shards.Shards`), and by language ``[log 1/V, the
    numbers of the two groups of orders 1..5]``.

    The arrays grow with the corpus and are made on the executors, order by order; the
    driver sees counts by language only.
    """
    total = {r.lang: r.total for r in grams.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    langs = sorted(total)
    if not langs:
        return "", {}
    spark = grams.sparkSession
    index = F.create_map(*[F.lit(x) for i, l in enumerate(langs) for x in (l, i)])
    t = grams.select(index[F.col("lang")].alias("l"), "code", F.col("n").alias("c"), F.col("n").alias("f"))
    orders = {ORDER: t}
    for o in range(ORDER - 1, 0, -1):
        up = orders[o + 1].groupBy("l", F.col("code").bitwiseAND((1 << 12 * o) - 1).alias("code"))
        orders[o] = table(up.agg(F.count(F.lit(1)).alias("c"), F.sum("f").alias("f")), "orders")
    one = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    models: dict[str, list] = {l: [] for l in langs}
    lower, every = None, None
    for o in range(1, ORDER + 1):
        t = orders[o]
        counts = t.groupBy("l").agg(F.count(F.lit(1)).alias("size"), *one).collect()
        d = spark.createDataFrame(
            [(r.l, *map(float, discounts(r.n1, r.n2, r.n3, r.n4)), 1.0 / (r["size"] + 1), float(floor * total[langs[r.l]])) for r in counts],
            "l int, d1 double, d2 double, d3 double, uniform double, least double",
        )
        h = t.groupBy("l", F.shiftright("code", 12).alias("ctx")).agg(F.sum("c").alias("den"), F.sum("f").alias("f"), *one[:2], F.sum((F.col("c") >= 3).cast("long")).alias("n3"))
        gamma = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("den")
        h = table(h.join(F.broadcast(d), "l").select("l", "ctx", "den", "f", gamma.alias("gamma"), "d1", "d2", "d3", "uniform", "least"), "contexts")
        g = t.withColumn("ctx", F.shiftright("code", 12)).join(h.drop("f"), ["l", "ctx"])
        if lower is None:
            g = g.withColumn("low", F.col("uniform"))
            for r in counts:
                models[langs[r.l]].append(-float(np.log(r["size"] + 1)))
        else:
            g = g.withColumn("suffix", F.col("code").bitwiseAND((1 << 12 * (o - 1)) - 1)).join(lower, ["l", "suffix"])
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        p = F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("den") + F.col("gamma") * F.col("low")
        g = table(g.select("l", "code", "f", "least", p.alias("p")), "probabilities")
        lower = g.select("l", F.col("code").alias("suffix"), F.col("p").alias("low"))
        often = F.lit(True) if o == 1 else F.col("f") >= F.col("least")
        for kind, part in enumerate((g.select("l", "code", "f", "least", F.log("p").alias("v")), h.select("l", F.col("ctx").alias("code"), "f", "least", F.log(F.greatest("gamma", F.lit(1e-9))).alias("v")))):
            part = part.filter(often).select((F.col("l") * (2 * ORDER) + (2 * (o - 1) + kind)).alias("g"), "code", F.col("v").cast("float").alias("v"))
            every = part if every is None else every.unionByName(part)
    for i, l in enumerate(langs):
        models[l] += [(i * 2 * ORDER + 2 * k, i * 2 * ORDER + 2 * k + 1) for k in range(ORDER)]
    return shards.write(every, len(langs) * 2 * ORDER), models


def log_probs(model: list, codes: np.ndarray) -> np.ndarray:
    """Natural-log probability of the last symbol of every 5-gram. ``model`` has the
    log of the uniform probability, and the arrays of each order."""
    out = np.zeros(len(codes), np.float32)
    todo = np.arange(len(codes))
    for o in range(ORDER, 0, -1):
        probs, weights = model[o]
        key = codes[todo] & np.uint64((1 << 12 * o) - 1)
        at = probs.find(key)
        hit = at >= 0
        out[todo[hit]] += probs.v[at[hit]]
        todo, key = todo[~hit], key[~hit]
        if not len(todo):
            return out
        at = weights.find(key >> np.uint64(12))
        out[todo] += np.where(at >= 0, weights.v[at], 0)
    out[todo] += model[0]
    return out


def with_scores(docs: DataFrame, built: tuple[str, dict], lang: str, text: str, score: str, count: str) -> DataFrame:
    """``docs`` with the mean log probability of a character and the number of characters."""
    path, models = built
    at_lang, at_text = docs.columns.index(lang), docs.columns.index(text)

    def run(b):
        groups = shards.opened(path)
        langs = pa.compute.cast(b.column(at_lang), pa.string()).to_pylist()
        texts = pa.compute.cast(b.column(at_text), pa.string()).to_pylist()
        sums, n = np.zeros(len(texts)), np.array([len(t) if t else 0 for t in texts], np.int64)
        by: dict[str, list[int]] = {}
        for i, l in enumerate(langs):
            if texts[i]:
                by.setdefault(NONE if l is None else l, []).append(i)
        for l, ids in by.items():
            ids = np.array(ids)
            model = [models[l][0], *((groups[a], groups[b]) for a, b in models[l][1:])]
            for cps, rows, lens in K.pieces([K.spelled(texts[i]) for i in ids], ORDER - 1):
                lp = log_probs(model, K.codes(cps, ORDER))
                np.add.at(sums, ids[rows], K.segment_sum(lp, K.starts(lens, ORDER - 1), lens))
        return [pa.array(sums / np.maximum(n, 1), mask=n == 0), pa.array(n)]

    return append(docs, run, **{score: "double", count: "long"})


def bands(scored: DataFrame, lang: str, score: str, count: str) -> DataFrame:
    """One row a language: ``lang, mid, wide, error``: the median score, the robust
    deviation of the scores, and that of a single character's share, over all documents."""
    g = scored.filter(F.col(score).isNotNull()).select(F.coalesce(col(lang).cast("string"), F.lit(NONE)).alias("lang"), F.col(score).alias("s"), F.col(count).alias("n"))
    median = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(10_000))
    mid = g.groupBy("lang").agg(median(F.col("s")).alias("mid"))
    off = F.abs(F.col("s") - F.col("mid"))
    return g.join(F.broadcast(mid), "lang").groupBy("lang").agg(
        F.first("mid").alias("mid"), (median(off) * 1.4826).alias("wide"), (median(off * F.sqrt("n")) * 1.4826).alias("error")
    )


def judged(docs: DataFrame, lang: str = "lang", text: str = "text", p: Bands = Bands()) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``[score, lower, upper, keep]`` columns under fresh names.

    ``keep`` is false for null and empty texts (they have no perplexity) and for those
    outside the band; a text exactly on a bound is kept. Repeated rows are judged alike.
    An empty table gives an empty result.
    """
    score, count, lo, hi, keep, l1, l2, mid, wide, error = fresh(docs, "ppl", "n_scored", "ppl_low", "ppl_high", "keep", "l1", "l2", "mid", "wide", "error")
    built = build(table(count_grams(docs, lang, text), "grams"), p.floor)
    scored = table(with_scores(docs, built, lang, text, score, count), "scored")
    b = bands(scored, lang, score, count).toDF(l2, mid, wide, error)
    dev = F.sqrt(F.col(wide) ** 2 + F.col(error) ** 2 / F.greatest(F.col(count), F.lit(1)))
    out = (
        scored.withColumn(l1, F.coalesce(col(lang).cast("string"), F.lit(NONE)))
        .join(F.broadcast(b), F.col(l1) == F.col(l2), "left")
        .withColumn(lo, F.exp(-F.col(mid) - p.low * dev))
        .withColumn(hi, F.exp(-F.col(mid) + p.high * dev))
        .withColumn(score, F.exp(-F.col(score)))
        .withColumn(keep, F.coalesce(F.col(score).between(F.col(lo), F.col(hi)), F.lit(False)))
        .drop(l1, l2, mid, wide, error)
    )
    return out, [score, lo, hi, keep, count]


def quality(docs: DataFrame, p: Bands = Bands()) -> DataFrame:
    """``doc_id, lang, perplexity, lower, upper, keep`` of every document.

    Null and empty texts have no perplexity and are not kept; a text exactly on a bound
    is. A null language is one of its own. Texts are read wholly, equal texts of a
    language are judged alike, repeated rows give repeated rows, and other columns are
    left aside. An empty table gives an empty result.
    """
    d = pick(docs, doc_id="long", lang="string", text="string")
    out, (score, lo, hi, keep, _) = judged(d, p=p)
    return out.select("doc_id", "lang", F.col(score).alias("perplexity"), F.col(lo).alias("lower"), F.col(hi).alias("upper"), F.col(keep).alias("keep"))


def filtered(docs: DataFrame, p: Bands = Bands()) -> DataFrame:
    """The documents that the rule keeps, with the columns they came with. Null and empty
    texts go; an empty table gives an empty result."""
    out, (_, _, _, keep, _) = judged(docs, p=p)
    return out.filter(F.col(keep)).select(*[col(c) for c in docs.columns])
