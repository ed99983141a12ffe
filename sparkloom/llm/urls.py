"""URL filter: gradient-boosted trees over lexical features of the address alone.

Features are length, depth, digit ratio, entropy, parameter counts and statistics of the
host's suffix. The training labels are those given, or by default those of a short
public-style blocklist of host words, which the model then replaces: it never sees the
words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from . import kernels as K
from . import shards
from .scratch import append, pick, table

BLOCKED = ("casino", "bets", "poker", "pills", "viagra", "porn", "xxx", "replica", "payday", "lottery", "spam")
NAMES = ("length", "host_length", "path_length", "depth", "params", "query_length", "digits", "host_digits", "entropy", "host_entropy", "labels", "hyphens", "host_hyphens", "longest_label", "https", "fragment", "port", "escapes", "ip_host", "suffix_rate", "suffix_count", "last_rate", "page_like", "upper")


@dataclass(frozen=True)
class Urls:
    """``sample``: labelled addresses, in seeded order, at most, from which the trees are
    learnt (suffixes are counted over all); ``held_out``: share of them that only calibrates; ``smooth``: pseudo-counts
    of a suffix's rate; ``cut``: probability from which an address is rejected."""

    sample: int = 50_000
    held_out: float = 0.3
    smooth: float = 20.0
    cut: float = 0.5
    seed: int = 3
    boost: gbt.Boost = field(default_factory=gbt.Boost)


def blocked(url: Column) -> Column:
    """1 if a word of the blocklist stands in the host between non-letters, else 0."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host.rlike(r"(^|[^a-z])(" + "|".join(BLOCKED) + r")([^a-z]|$)").cast("int")


def parts(url: str) -> tuple[str, str, str, str, str]:
    """``(scheme, host with port, path, query, fragment)``; never fails."""
    rest, _, fragment = url.strip().partition("#")
    rest, _, query = rest.partition("?")
    scheme, sep, tail = rest.partition("://")
    if not sep:
        scheme, tail = "", rest.removeprefix("//")
    host, slash, path = tail.partition("/")
    return scheme.lower(), host.rpartition("@")[2].lower(), slash + path, query, fragment


def suffixes(host: str) -> tuple[str, str]:
    """The last two labels of a host and its last one."""
    labels = host.partition(":")[0].split(".")
    return ".".join(labels[-2:]), labels[-1]


def _entropy(s: str) -> float:
    if not s:
        return 0.0
    n = np.unique(K.points(s), return_counts=True)[1] / len(s)
    return float(-(n * np.log2(n)).sum())


def features(urls: list[str], rates: dict[str, tuple[float, float]], base: float) -> np.ndarray:
    """One row of :data:`NAMES` an address."""
    out = np.zeros((len(urls), len(NAMES)))
    for i, u in enumerate(urls):
        scheme, host, path, query, fragment = parts(u)
        name, _, port = host.partition(":")
        labels = name.split(".")
        two, last = suffixes(host)
        r2, n2 = rates.get(two, (base, 0.0))
        digits = sum(c.isdigit() for c in u)
        out[i] = (
            len(u), len(name), len(path), path.count("/"), len([x for x in query.split("&") if x]), len(query), digits / max(1, len(u)),
            sum(c.isdigit() for c in name) / max(1, len(name)), _entropy(u), _entropy(name), len(labels), u.count("-"), name.count("-"), max(map(len, labels)),
            scheme == "https", bool(fragment), bool(port), u.count("%"), all(x.isdigit() for x in labels if x), r2, np.log1p(n2), rates.get("." + last, (base, 0.0))[0],
            path.endswith((".html", ".htm", ".php", "/")), sum(c.isupper() for c in u) / max(1, len(u)),
        )
    return out


def _keys(url: str) -> tuple[tuple[str, int], ...]:
    """The suffixes of an address as :func:`features` names them, with their 64-bit hashes."""
    two, last = suffixes(parts(url)[1])
    return tuple((k, int.from_bytes(blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)) for k in (two, "." + last))


def suffix_counts(known: DataFrame) -> DataFrame:
    """``(code, half, s, n)``: rejected and all labelled addresses by suffix, for each half
    of the addresses."""

    def run(batches):
        for b in batches:
            sums: dict[tuple[int, int], list[int]] = {}
            for u, y, half in zip(K.column(b, "url"), K.column(b, "label"), K.column(b, "half")):
                for _, code in _keys(u):
                    s = sums.setdefault((code, half), [0, 0])
                    s[0] += y
                    s[1] += 1
            rows = [(*k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["code", "half", "s", "n"])

    return known.select("url", "label", "half").mapInArrow(run, "code long, half long, s long, n long").groupBy("code", "half").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _rate(s: float, n: float, base: float, p: Urls) -> tuple[float, float]:
    """Smoothed rate of rejected addresses of a suffix, and their number."""
    return (s + p.smooth * base) / (n + p.smooth), n


def train(got: pa.Table, counts: DataFrame, bases: list[float], p: Urls) -> gbt.Model:
    """Trees and calibration from the addresses ``url, label, half``. The statistics of
    their suffixes come from the other half of all labelled ones, so that no row sees its
    own label."""
    urls, y, half = got["url"].to_pylist(), got["label"].to_numpy().astype(float), got["half"].to_numpy()
    names = {code: k for u in urls for k, code in _keys(u)}
    rates: list[dict] = [{}, {}]
    if names:
        asked = counts.sparkSession.createDataFrame([(c,) for c in names], "code long")
        for r in counts.join(F.broadcast(asked), "code").collect():
            rates[r.half][names[r.code]] = _rate(r.s, r.n, bases[r.half], p)
    X = np.zeros((len(y), len(NAMES)))
    for h in (0, 1):
        own = np.flatnonzero(half == h)
        X[own] = features([urls[i] for i in own], rates[1 - h], bases[1 - h])
    out = np.random.default_rng(p.seed).random(len(y)) < p.held_out
    return gbt.calibrate(gbt.fit(X[~out], y[~out], p.boost), X[out], y[out])


def score(pages: DataFrame, labels: DataFrame | None = None, p: Urls = Urls()) -> DataFrame:
    """``page_id, url, unwanted, reject`` of every page: the calibrated probability, and
    whether it reaches ``cut``.

    ``labels`` has ``url, label`` (0 or 1; others are left out; of conflicting labels of
    one address the 1 counts). A null or blank address has probability 0 and is not
    rejected; a probability of exactly ``cut`` is. Addresses of any length are read
    wholly, other columns left aside. Repeated rows give repeated rows. Without labelled
    addresses the model is constant; an empty table gives an empty result.
    """
    d = pick(pages, page_id="long", url="string")
    known = d.select("url", blocked(F.col("url")).alias("label")) if labels is None else pick(labels, url="string", label="int")
    known = known.filter("label in (0, 1) and trim(url) <> ''").groupBy("url").agg(F.max("label").alias("label"))
    known = table(known.withColumn("half", F.pmod(F.xxhash64(F.lit(~p.seed), "url"), F.lit(2)).cast("int")), "urls")
    counts = table(suffix_counts(known), "suffixes")
    sums = {r.half: (r.s, r.n) for r in known.groupBy("half").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    bases = [s / n if n else 0.0 for s, n in (sums.get(h, (0, 0)) for h in (0, 1))]
    base = sum(s for s, _ in sums.values()) / max(1, sum(n for _, n in sums.values()))
    got = known.orderBy(F.xxhash64(F.lit(p.seed), "url"), "url").limit(p.sample).toArrow().sort_by("url")
    held = d.sparkSession.sparkContext.broadcast((train(got, counts, bases, p), base))
    both = counts.groupBy("code").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    every = both.select("code", F.posexplode(F.array(F.col("s").cast("float"), F.col("n").cast("float"))).alias("g", "v"))
    made = shards.write(every.select("g", "code", "v"), 2) if sums else ""

    def run(b):
        model, base = held.value
        urls = [u or "" for u in b.column(1).to_pylist()]
        names = {code: k for u in urls for k, code in _keys(u)}
        rates = {}
        if made:
            s, n = shards.opened(made)
            codes = np.array(list(names), np.int64).astype(np.uint64)
            i, j = s.find(codes), n.find(codes)
            rates = {k: _rate(float(s.v[x]), float(n.v[z]), base, p) for k, x, z in zip(names.values(), i, j) if x >= 0}
        q = model.probability(features(urls, rates, base))
        q[[not u.strip() for u in urls]] = 0
        return [pa.array(q), pa.array(q >= p.cut)]

    return append(d, run, unwanted="double", reject="boolean").select("page_id", "url", "unwanted", "reject")
