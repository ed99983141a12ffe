"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates. The lexicon is learnt from labelled documents: words and stems
whose log odds of occurring in toxic ones are significantly high, beside a short general list.
Documents from which the trees or their calibration are learnt get their features by a
lexicon of the other folds, so that none sees its own label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from . import kernels as K
from . import shards
from .scratch import append, pick, table

GENERAL = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile dumb ugly hate shut kill idiota imbécil estúpido basura dummkopf idiotin trottel abschaum müll imbécile crétin ordure connard".split()
SECOND = "you your yours yourself u ur du dich dir dein deine deiner ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
STEMS = (3, 5, 7)
NAMES = ("learnt", "learnt_share", *(f"stem{n}{x}" for n in STEMS for x in ("", "_share")), "general", "general_share", "distinct", "near_you", "you_share", "least_gap", "caps", "caps_words", "exclaim", "punct", "leet", "leet_hits", "stretched", "spaced", "words")
_C = NAMES.index("distinct")
_LEET = str.maketrans("013457@$!", "oleastasi")


@dataclass(frozen=True)
class Toxic:
    """``sample``: labelled documents, in seeded order, from which the trees are learnt
    (the lexicon comes from all); ``held_out``: share of them that only calibrates;
    ``z``: least significance of a learnt word or stem, ``ratio``: least ratio of its rates in toxic and other
    documents, ``least``: documents it must occur in; ``near``: words between a
    hit and a second person at most; ``cut``: probability from which a document is
    toxic; ``folds``: parts of the labelled documents; ``seed``: of the order."""

    sample: int = 8000
    held_out: float = 0.3
    z: float = 4.0
    ratio: float = 6.0
    least: int = 4
    near: int = 5
    cut: float = 0.5
    folds: int = 4
    seed: int = 5
    boost: gbt.Boost = field(default_factory=gbt.Boost)


def lexicon(words: list[str]) -> K.HashArray:
    """The words' hashes, to be looked up."""
    h = np.unique(K.words([" ".join(words)])[0])
    return K.HashArray(h, np.ones(len(h), np.float32))


def fold(ids: np.ndarray, p: Toxic) -> np.ndarray:
    """Which part of the labelled documents each id belongs to."""
    return (K.mix(ids.astype(np.uint64)) % np.uint64(p.folds)).astype(np.int64)


def features(texts: list[str], learnt: K.HashArray, p: Toxic) -> np.ndarray:
    """One row of :data:`NAMES` a text; all zeros for one without words."""
    out = np.zeros((len(texts), len(NAMES)))
    general, second = lexicon(GENERAL), lexicon(SECOND)

    def member(h, held):
        return held.find(h) >= 0

    for at, part in K.chunks(texts):
        h, row, _, _, *stems = K.words(part, STEMS)
        n = np.bincount(row, minlength=len(part)).astype(float)
        some = np.maximum(n, 1)
        hit, known, you = member(h, learnt), member(h, general), member(h, second)
        count = lambda m: np.bincount(row[m], minlength=len(part)).astype(float)
        rows = slice(at, at + len(part))
        both = hit | known
        for k, m in enumerate((hit, *(member(x, learnt) for x in stems), known)):
            out[rows, 2 * k] = count(m)
            out[rows, 2 * k + 1] = out[rows, 2 * k] / some
        if both.any():
            key = np.unique((row[both].astype(np.uint64) << np.uint64(40)) | (h[both] >> np.uint64(24)))
            out[rows, _C] = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=len(part))
        out[rows, _C + 2] = count(you) / some
        gap = np.full(len(part), 50.0)
        where, yous = np.flatnonzero(both), np.flatnonzero(you)
        if len(where) and len(yous):
            right = np.searchsorted(yous, where)
            least = np.full(len(where), 50.0)
            for cand in (np.maximum(right - 1, 0), np.minimum(right, len(yous) - 1)):
                d = np.abs(yous[cand] - where).astype(float)
                d[row[yous[cand]] != row[where]] = 50
                least = np.minimum(least, d)
            np.minimum.at(gap, row[where], least)
            out[rows, _C + 1] = np.bincount(row[where[least <= p.near]], minlength=len(part))
        out[rows, _C + 3] = np.where(n > 0, np.minimum(gap, 50), 0)
        for i, t in enumerate(part, at):
            if t:
                out[i, _C + 4 : _C + 12] = _surface(t, known_words=_KNOWN)
        out[rows, -1] = np.log1p(n)
    return out


_KNOWN = frozenset(GENERAL)


def _surface(t: str, known_words: frozenset) -> tuple:
    """Rates of a text's characters: capitals, capital words, exclamation, punctuation,
    look-alike digits and signs, hits behind them, stretched letters, spaced letters."""
    m = len(t)
    cps = K.points(t)
    kind = K._classes()[cps] > 0
    upper = (cps >= 65) & (cps <= 90) | (cps >= 0xC0) & (cps <= 0xDE) & (cps != 0xD7)
    letter = kind & ~((cps >= 48) & (cps <= 57)) & (cps != 95)
    odd = np.isin(cps, _ODD)
    inner = np.zeros(m, bool)
    inner[1:-1] = letter[:-2] & odd[1:-1] & letter[2:]
    hits = 0
    for i in np.flatnonzero(inner).tolist():
        a, b = i, i + 1
        while a and not t[a - 1].isspace():
            a -= 1
        while b < m and not t[b].isspace():
            b += 1
        if b - a <= 24 and t[a:b].lower().translate(_LEET).strip(".,;:!?i") in known_words:
            hits += 1
    same = np.zeros(m, bool)
    same[2:] = letter[2:] & (cps[2:] == cps[1:-1]) & (cps[1:-1] == cps[:-2])
    alone = letter.copy()
    alone[1:] &= ~kind[:-1]
    alone[:-1] &= ~kind[1:]
    run = np.zeros(m, bool)
    run[4:] = alone[4:] & alone[2:-2] & alone[:-4]
    pair = np.zeros(m, bool)
    pair[1:] = upper[1:] & upper[:-1]
    space = int((~kind & (cps == 32)).sum()) + 1
    return (upper.sum() / m, pair.sum() / m, int((cps == 33).sum()) / m, int((~kind & (cps > 32)).sum()) / m, inner.sum() / space, hits, same.sum() / space, run.sum() / space)


_ODD = np.array([ord(c) for c in "013457@$!*"], np.uint32)


def _labels(ids: np.ndarray, made: str) -> tuple[np.ndarray, np.ndarray]:
    """``(which ids have a label, the labels)``, looked up in mapped files, so that texts
    are not shuffled."""
    (labels,) = shards.opened(made)
    got = labels.find(ids.astype(np.uint64))
    has = np.flatnonzero(got >= 0)
    return has, labels.v[got[has]].astype(np.int64)


def _known(docs: DataFrame, made: str) -> DataFrame:
    """``(doc_id, y)`` of the rows that have a label."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            has, y = _labels(ids, made)
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(y.astype(np.int32))], ["doc_id", "y"])

    return docs.select("doc_id").mapInArrow(run, "doc_id long, y int")


def _word_counts(docs: DataFrame, made: str, p: Toxic) -> DataFrame:
    """``(word, fold, toxic, total)``: labelled documents in which each word or stem occurs."""

    def run(batches):
        held: dict[int, list[tuple]] = {}

        def fold_up(f):
            k, t, n = map(np.concatenate, zip(*held[f]))
            keys, total = K.tally(k, n)
            held[f] = [(keys, np.bincount(np.searchsorted(keys, k), t, len(keys)).astype(np.int64), total)]

        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            has, y = _labels(ids, made)
            part_of = fold(ids[has], p)
            for f in np.unique(part_of).tolist():
                own = np.flatnonzero(part_of == f)
                texts = b.column("text").take(pa.array(has[own])).to_pylist()
                for at, part in K.chunks(texts, K.CHUNK // 4):
                    h, row, _, _, *stems = K.words(part, STEMS)
                    h, row = np.concatenate([h, *stems]), np.tile(row, 1 + len(STEMS))
                    h, row = h[h != 0], row[h != 0]
                    o = np.lexsort((h, row))
                    h, row = h[o], row[o]
                    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
                    h, t = h[new], y[own[at + row[new]]]
                    keys, total = K.tally(h)
                    held.setdefault(f, []).append((keys, np.bincount(np.searchsorted(keys, h), t, len(keys)).astype(np.int64), total))
                    if len(held[f]) > 12:
                        fold_up(f)
        for f in held:
            fold_up(f)
            for at in range(0, len(held[f][0][0]), 200_000):
                keys, toxic, total = (x[at : at + 200_000] for x in held[f][0])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), f, np.int32)), pa.array(toxic), pa.array(total)], ["word", "fold", "toxic", "total"])

    return docs.mapInArrow(run, "word long, fold int, toxic long, total long")


def learn(docs: DataFrame, made: str, ids: DataFrame, p: Toxic) -> str:
    """The folder of the lexicons: group f is learnt without fold f, the last from all.

    Words are counted over all labelled documents and looked up in mapped files, so that
    neither their number nor the lexicon's is bounded by a worker's memory."""
    part = F.pmod(F.col("fold"), F.lit(p.folds))
    sizes = np.zeros((p.folds, 2))

    def tallied(batches):
        for b in batches:
            f = fold(b.column("doc_id").to_numpy(), p)
            y = b.column("y").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.folds, dtype=np.int32)), pa.array(np.bincount(f, y, p.folds).astype(np.int64)), pa.array(np.bincount(f, minlength=p.folds))], ["fold", "toxic", "n"])

    for r in ids.mapInArrow(tallied, "fold int, toxic long, n long").groupBy("fold").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).collect():  # a row a fold
        sizes[r.fold] = r.toxic, r.n
    own = [F.sum(F.when(part == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(p.folds) for c in ("toxic", "total")]
    counts = _word_counts(docs, made, p).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"), *own)

    def high(f: int):
        toxic, n = sizes.sum(axis=0) - (sizes[f] if f < p.folds else 0)
        a = F.col("toxic") - (F.col(f"toxic{f}") if f < p.folds else 0)
        b = F.col("total") - (F.col(f"total{f}") if f < p.folds else 0) - a
        rate, other = (a + 0.5) / F.lit(float(toxic + 1)), (b + 0.5) / F.lit(float(n - toxic + 1))
        return (a >= p.least) & ((F.log(rate) - F.log(other)) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= p.z) & (rate > p.ratio * other)

    groups = F.filter(F.array(*[F.when(high(f), F.lit(f)) for f in range(p.folds + 1)]), lambda x: x.isNotNull())
    return shards.write(counts.select(F.col("word").alias("code"), F.explode(groups).alias("g")).select("g", "code", F.lit(1.0).cast("float").alias("v")), p.folds + 1)


def train(docs: DataFrame, labels: DataFrame, p: Toxic) -> tuple[gbt.Model, str]:
    """``(model, lexicons)``: trees and calibration from at most ``sample`` labelled
    documents that have a text, the lexicons from all of them.

    Labels other than 0 and 1 are left out; of conflicting labels of one id the toxic one
    counts. Without labelled documents the model is constant and the lexicon empty.
    """
    known = pick(labels, doc_id="long", toxic="int").filter("toxic in (0, 1) and doc_id is not null")
    known = table(known.groupBy("doc_id").agg(F.max("toxic").alias("y")), "labels")
    constant = gbt.fit(np.zeros((0, len(NAMES))), np.zeros(0), p.boost), ""
    if known.isEmpty():
        return constant
    made = shards.write(known.select(F.lit(0).alias("g"), F.col("doc_id").alias("code"), F.col("y").cast("float").alias("v")), 1)
    texts = docs.filter("text is not null and doc_id is not null").select("doc_id", "text")
    ids = table(_known(texts, made), "ids")
    if ids.isEmpty():
        return constant
    learnt = learn(texts, made, ids, p)

    def run(batches):
        held = shards.opened(learnt)
        for b in batches:
            part, rows = fold(b.column("doc_id").to_numpy(), p), K.column(b, "text")
            X = np.zeros((len(rows), len(NAMES)))
            for f in np.unique(part).tolist():
                own = np.flatnonzero(part == f)
                X[own] = features([rows[i] or "" for i in own], held[f], p)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(X), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    order = F.xxhash64(F.lit(p.seed), "doc_id")
    some = ids.distinct().orderBy(order, "doc_id").limit(p.sample)
    got = texts.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    X = np.array(got["x"].to_pylist()).reshape(-1, len(NAMES))
    y = got["y"].to_numpy().astype(float)
    out = np.random.default_rng(p.seed).random(len(y)) < p.held_out
    return gbt.calibrate(gbt.fit(X[~out], y[~out], p.boost), X[out], y[out]), learnt


def score(docs: DataFrame, labels: DataFrame, p: Toxic = Toxic()) -> DataFrame:
    """``doc_id, toxicity, toxic`` of every document: the calibrated probability, and
    whether it reaches ``cut``.

    Null and empty texts have probability 0; a probability of exactly ``cut`` is toxic.
    Texts are read wholly. Repeated rows give repeated rows; other columns are left
    aside. An empty table gives an empty result.
    """
    d = pick(docs, doc_id="long", text="string")
    held = d.sparkSession.sparkContext.broadcast(train(d, labels, p))

    def run(b):
        model, made = held.value
        learnt = shards.opened(made)[-1] if made else K.HashArray(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        texts = [t or "" for t in b.column(1).to_pylist()]
        X = features(texts, learnt, p)
        q = model.probability(X)
        q[X[:, -1] == 0] = 0
        return [pa.array(q), pa.array(q >= p.cut)]

    return append(d, run, toxicity="double", toxic="boolean").select("doc_id", "toxicity", "toxic")
