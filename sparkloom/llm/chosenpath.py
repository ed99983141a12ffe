"""N-gram Jaccard join by chosen paths (Christiani, Pagh, Sivertsen 2018).

Every text is the set of its word 3-grams. Sets are embedded in ``HASHES`` min-hash
coordinates; a node of the recursion splits its sets on coordinates that its path
chooses, so that sets which share a sampled token meet again. In a node of more than
``bucket`` sets, those close to a seeded pivot are linked to it and the others are
split further; nodes of at most ``bucket`` sets are compared by brute force, and those
that are still larger at the last level are compared block against block, so that no
case is left out. Independent runs are repeated until the target recall.

A node yields links that connect its similar sets, not all their pairs, so that what is
shuffled grows with the sets. Links that rest on an unsure estimate are verified; the
exact sets of every group that the others connect are then compared with each other in
blocks, which yield a row a set, not a row a pair. Blocks are read in slices of the
grams' range, so that long texts take no more memory than short ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import kernels as K
from .scratch import col, fresh, pick, table

HASHES = 64
_A = (K.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


@dataclass(frozen=True)
class Join:
    """``threshold``: least Jaccard similarity; ``n``: words a gram; ``recall``: target
    for pairs at the threshold (those above it are found more surely); ``bucket``: sets
    that are compared by brute force; ``depth``: levels of splitting at most; ``slack``:
    sets are linked if their min-hash estimate is above the threshold less this, three
    standard errors at the default; ``sure``: an estimate this much above the threshold
    is taken as a sure link; ``block``: exact sets compared at a time; ``span``: about
    the grams of two blocks that are held at a time."""

    threshold: float = 0.5
    n: int = 3
    recall: float = 0.97
    bucket: int = 64
    depth: int = 6
    slack: float = 0.19
    sure: float = 0.1
    block: int = 512
    span: int = 1 << 18
    seed: int = 1

    @property
    def fan(self) -> int:
        """Coordinates that a node samples: their expected matches are at least one."""
        return ceil(1 / self.threshold)

    @property
    def runs(self) -> int:
        """Independent runs for the target recall of pairs at the threshold which are
        split three times."""
        q = 1.0
        for _ in range(3):
            q = 1 - (1 - self.threshold * q) ** self.fan
        return max(1, ceil(log(1 - self.recall) / log(1 - q)))


def _signatures(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, id, min-hashes)`` of the texts that have words."""
    h, row, _, _ = K.words(texts)
    if not len(h):
        return row, h, np.zeros((0, HASHES), np.uint32)
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    up, down = K._powers(1 << max(10, int(len(h)).bit_length()))
    sid = K.mix(np.add.reduceat(h * up[: len(h)], at) * down[at] + np.diff(np.append(at, len(h))).astype(np.uint64))
    g, grow, _ = K.grams(h, row, n)
    gat = np.flatnonzero(np.concatenate([[True], grow[1:] != grow[:-1]]))
    g32 = (g >> np.uint64(32)).astype(np.uint32)
    sig = np.empty((len(gat), HASHES), np.uint32)
    for k in range(HASHES):
        x = g32 * _A[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        sig[:, k] = np.minimum.reduceat(x, gat)
    return row[at], sid, sig


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, sid, sig)`` of every row with an id and at least one word. ``sid`` is a
    64-bit hash of the word sequence: equal for copies."""

    def run(batches):
        for b in batches:
            ids, texts = K.column(b, "doc_id"), [t or "" for t in K.column(b, "text")]
            for at, part in K.chunks(texts):
                row, sid, sig = _signatures(part, n)
                if len(row):
                    own = pa.array([ids[at + r] for r in row], pa.int64())
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * HASHES), len(row), [None, pa.py_buffer(sig.tobytes())])
                    yield pa.RecordBatch.from_arrays([own, pa.array(sid.astype(np.int64)), raw.cast(pa.binary())], ["doc_id", "sid", "sig"])

    return docs.filter("doc_id is not null").mapInArrow(run, "doc_id long, sid long, sig binary")


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _children(nodes: np.ndarray, sig: np.ndarray, fan: int) -> np.ndarray:
    """Child nodes, ``fan`` a row: the path chooses the coordinates, the set's min-hash
    there chooses the branch."""
    out, rows = np.empty((len(nodes), fan), np.uint64), np.arange(len(nodes))
    base = K.mix(nodes)
    at = (base % np.uint64(HASHES)).astype(np.int64)
    step = ((base >> np.uint64(20)) % np.uint64(HASHES // 2)).astype(np.int64) * 2 + 1  # odd: distinct coordinates
    for j in range(fan):
        i = (at + j * step) % HASHES
        out[:, j] = K.mix(base ^ (sig[rows, i].astype(np.uint64) | (i.astype(np.uint64) << np.uint64(32)) | np.uint64(1 << 40)))
    return out


def _expand(df: DataFrame, p: Join, root: bool) -> DataFrame:
    """``(node, sid)`` of the next level, from ``(sid, sig)`` or ``(node, sid, sig)``."""

    def run(batches):
        for b in batches:
            sid, sig = b.column("sid").to_numpy(zero_copy_only=False), _sigs(b.column("sig"))
            if not len(sid):
                continue
            if root:
                start = K.mix(np.arange(p.runs, dtype=np.uint64) + np.uint64(p.seed << 20))
                nodes = np.concatenate([_children(np.full(len(sid), s, np.uint64), sig, p.fan) for s in start], axis=1)
            else:
                nodes = _children(b.column("node").to_numpy(zero_copy_only=False).astype(np.uint64), sig, p.fan)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.ravel().astype(np.int64)), pa.array(np.repeat(sid, nodes.shape[1]))], ["node", "sid"]
            )

    return df.mapInArrow(run, "node long, sid long")


def _links(i: np.ndarray, j: np.ndarray, est: np.ndarray, size: int, p: Join) -> list[int]:
    """Which of a node's pairs (i < j, estimates above the slack) to keep: a forest of the
    sure ones, each set with its first sure partner where that suffices, and all unsure
    ones between different trees."""
    root = list(range(size))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep, sure = [], est >= (p.threshold + p.sure) * HASHES
    for e in np.flatnonzero(sure).tolist():
        a, b = top(int(i[e])), top(int(j[e]))
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(e)
    return keep + [e for e in np.flatnonzero(~sure).tolist() if top(int(i[e])) != top(int(j[e]))]


def _compare(groups: DataFrame, p: Join) -> DataFrame:
    """Links ``(a, b, sure)``, ``a < b``, between the similar sets of each group.

    A group holds one block of a node (all pairs) or two (pairs across)."""
    least = (p.threshold + p.sure) * HASHES

    def run(batches):
        for b in batches:
            m = b.column("m")
            off = np.asarray(m.offsets)
            flat = m.values[off[0] : off[-1]]
            off = off - off[0]
            sid = flat.field("sid").to_numpy(zero_copy_only=False)
            blk = flat.field("blk").to_numpy(zero_copy_only=False)
            if not len(sid):
                continue
            group = np.repeat(np.arange(len(off) - 1), np.diff(off))
            order = np.lexsort((sid, group))  # equal partners first in every node
            sid, blk, sig = sid[order], blk[order], _sigs(flat.field("sig"))[order]
            size = np.diff(off)
            across = np.minimum.reduceat(blk, off[:-1]) != np.maximum.reduceat(blk, off[:-1])
            a, c, sure = [], [], []
            for k in np.unique(size):
                if k < 2:
                    continue
                i, j = np.triu_indices(k, 1)
                at = np.flatnonzero(size == k)
                for part in np.array_split(at, max(1, len(at) * len(i) // 50_000)):
                    x, y = (off[part][:, None] + i).ravel(), (off[part][:, None] + j).ravel()
                    est = (sig[x] == sig[y]).sum(axis=1)
                    ok = (est >= (p.threshold - p.slack) * HASHES) & (sid[x] != sid[y])
                    ok &= ~np.repeat(across[part], len(i)) | (blk[x] != blk[y])
                    if k == 2:
                        a.append(sid[x[ok]]), c.append(sid[y[ok]]), sure.append(est[ok] >= least)
                        continue
                    ok = ok.reshape(len(part), -1)
                    est = est.reshape(len(part), -1)
                    for g in np.flatnonzero(ok.any(axis=1)):
                        e = np.flatnonzero(ok[g])
                        e = e[_links(i[e], j[e], est[g, e], int(k), p)]
                        a.append(sid[off[part[g]] + i[e]]), c.append(sid[off[part[g]] + j[e]]), sure.append(est[g, e] >= least)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, c, sure)], ["a", "b", "sure"])

    return groups.mapInArrow(run, "a long, b long, sure boolean")


def _pivoted(members: DataFrame, p: Join) -> DataFrame:
    """``(node, sid, sig, pivot, copy)`` of large nodes' sets: ``pivot`` is the node's
    pivot where the set is perhaps similar to it, ``copy`` is true where it surely is, so
    that the set need not be split further."""
    pivot = members.groupBy("node").agg(F.min(F.struct(F.xxhash64("node", "sid").alias("h"), "sid", "sig")).alias("p"))
    rows = members.join(pivot, "node").select("node", "sid", "sig", F.col("p.sid").alias("psid"), F.col("p.sig").alias("psig"))

    def run(batches):
        for b in batches:
            sid, own = b.column("sid").to_numpy(zero_copy_only=False), b.column("psid").to_numpy(zero_copy_only=False)
            if len(sid):
                est = (_sigs(b.column("sig")) == _sigs(b.column("psig"))).sum(axis=1)
                near = (est >= (p.threshold - p.slack) * HASHES) & (sid != own)
                copy = (est >= (p.threshold + p.sure) * HASHES) & near
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("sid"), b.column("sig"), pa.array(own, mask=~near), pa.array(copy)], ["node", "sid", "sig", "pivot", "copy"])

    return rows.mapInArrow(run, "node long, sid long, sig binary, pivot long, copy boolean")


def links(sets: DataFrame, p: Join) -> DataFrame:
    """Links ``(a, b, sure)`` that connect the similar ones of the sets ``(sid, sig)``.

    Those to a pivot are sure also where the estimate is not: a set that was not split
    for being like the pivot may be similar to one that is less so."""
    active, found, out = _expand(sets, p, root=True), None, None
    for level in range(1, p.depth + 1):
        active = table(active, "nodes")
        sized = table(active.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
        last = level == p.depth or (sized.agg(F.max("n")).first()[0] or 0) <= p.bucket
        members = active.join(sized, "node")
        ripe = members if last else members.filter(F.col("n") <= p.bucket)
        found = ripe if found is None else found.unionByName(ripe)
        if last:
            break
        large = members.filter(F.col("n") > p.bucket).select("node", "sid").join(sets, "sid")
        large = table(_pivoted(large, p), "pivoted")
        star = large.filter("pivot is not null").select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b"), F.lit(True).alias("sure"))
        out = star if out is None else out.unionByName(star)
        active = _expand(large.filter("not copy").select("node", "sid", "sig"), p, root=False)
    own = F.col("blk")
    every = found.withColumn("nb", F.ceil(F.col("n") / F.lit(p.bucket)).cast("int")).withColumn("blk", F.pmod(F.xxhash64("sid", "node"), F.col("nb")).cast("int"))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    grouped = (
        every.join(sets, "sid")
        .groupBy("node", F.least(own, F.col("other")).alias("i"), F.greatest(own, F.col("other")).alias("j"))
        .agg(F.collect_list(F.struct("sid", "blk", "sig")).alias("m"))
        .select("m")
    )
    compared = _compare(grouped, p)
    return (compared if out is None else compared.unionByName(out)).groupBy("a", "b").agg(F.bool_or("sure").alias("sure"))


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, sid, grams)``: the exact set of 64-bit gram hashes of each text, in the
    order of unsigned numbers."""

    def run(batches):
        for b in batches:
            ids, texts = K.column(b, "doc_id"), [t or "" for t in K.column(b, "text")]
            for at, part in K.chunks(texts):
                row, sid, _ = _signatures(part, n)
                h, hrow, _, _ = K.words(part)
                g, grow, _ = K.grams(h, hrow, n)
                cut = np.searchsorted(grow, np.arange(len(part) + 1))
                sets = [np.unique(g[cut[r] : cut[r + 1]]).astype(np.int64) for r in row]
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[at + r] for r in row], pa.int64()), pa.array(sid.astype(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "sid", "grams"]
                    )

    return docs.mapInArrow(run, "doc_id long, sid long, grams array<long>")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the values of a column of lists."""
    off = np.asarray(column.offsets).astype(np.int64)
    return off - off[0], column.values.slice(off[0], off[-1] - off[0])


def _cut(batches):
    """A row for each of the ``slices`` of a set: those of its ``grams`` that lie in the same
    part of their range, also where there are none."""
    for b in batches:
        n, (off, flat) = b.column("slices").to_numpy(), _lists(b.column("grams"))
        grams = flat.to_numpy().view(np.uint64)
        at, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        new = np.append(0, off[1:][at])
        for r in np.flatnonzero(n > 1).tolist():
            edges = np.arange(1, n[r], dtype=np.uint64) * np.uint64((1 << 64) // int(n[r]))
            new[first[r] + 1 : first[r] + n[r]] = off[r] + np.searchsorted(grams[off[r] : off[r + 1]], edges)
        parts = {"grams": pa.ListArray.from_arrays(pa.array(new, pa.int32()), flat), "slice": pa.array(np.arange(len(at)) - first[at], pa.int32())}
        rows = {c: b.column(c).take(pa.array(at)) for c in b.schema.names if c != "grams"}
        yield pa.RecordBatch.from_pydict(rows | parts)


def _add_shared(both: np.ndarray, lists: pa.ListArray) -> None:
    """Add to ``both`` the numbers of values that every two of the lists share."""
    off, flat = _lists(lists)
    row = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(off))
    flat = flat.to_numpy()
    o = np.argsort(flat, kind="stable")
    flat, row = flat[o], row[o]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram) > 1
    use = shared[gram]
    row, gram = row[use], (np.cumsum(shared) - 1)[gram[use]]
    total = int(shared.sum())
    for at in range(0, total, 4096):
        width = min(4096, total - at)
        lo, hi = np.searchsorted(gram, [at, at + width])
        m = np.zeros((len(lists), width), np.float32)
        m[row[lo:hi], gram[lo:hi] - at] = 1
        both += m @ m.T


def _alike(both: np.ndarray, size: np.ndarray, p: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, similarity)`` of the similar pairs of sets, exactly."""
    i, j = np.triu_indices(len(size), 1)
    same = both[i, j].astype(np.int64)
    jac = same / np.maximum(1, size[i] + size[j] - same)
    ok = jac >= p.threshold
    return i[ok], j[ok], jac[ok]


def _labels(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The least member of the connected group of each of ``size`` sets with pairs (i, j)."""
    label = np.arange(size)
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches, keys: list[str]):
    """The rows of each run of equal ``keys``, which may go over several batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy() for c in keys])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            if held and (key[:, lo] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key[:, lo]
    if held:
        yield pa.Table.from_batches(held)


def _exactly(batches, p: Join):
    """Compare the sets of every ``(component, i, j)``, whose slices follow one another, each
    with a row of every set in the same order. Only one slice is held at a time."""
    out, held = [], 0
    for t in _runs(batches, ["component", "i", "j", "slice"]):
        at, slices = t["slice"][0].as_py(), t["slices"][0].as_py()
        if at == 0:
            both = np.zeros((t.num_rows, t.num_rows))
        if t.num_rows > 1:
            lists = t["grams"].combine_chunks()
            _add_shared(both, lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists)
        if at < slices - 1:
            continue
        sid, blk, copies, size = (t[c].to_numpy() for c in ("sid", "blk", "copies", "size"))
        i, j, jac = _alike(both, size, p)
        if t["i"][0].as_py() != t["j"][0].as_py():
            across = blk[i] != blk[j]
            i, j, jac = i[across], j[across], jac[across]
        n, best = np.zeros(len(sid), np.int64), np.zeros(len(sid))
        for x, y in ((i, j), (j, i)):
            np.add.at(n, x, copies[y])
            np.maximum.at(best, x, jac)
        some = np.flatnonzero(n)
        out.append((sid[some], sid[_labels(i, j, len(sid))[some]], n[some], best[some]))
        held += len(some)
        if held >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b", "n", "best"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b", "n", "best"])


def similar(groups: DataFrame, exact: DataFrame, p: Join) -> DataFrame:
    """``(a, b, n, best)`` from all similar pairs within the groups ``(node, component)``.

    A group of more than ``block`` sets is divided, and every two of its blocks meet in
    one task, which yields a row for each set ``a`` that has a pair there: the set ``b``
    that stands for the ones that its pairs connect, the documents ``n`` of its partners
    and the greatest similarity. Rows thus follow sets and blocks, not pairs. A task reads
    two blocks in slices of about ``span`` grams, of which there are as many as the group's
    grams need, and adds up what pairs share: its memory follows neither the length nor
    the number of the texts."""
    own = F.col("blk")
    nb = F.ceil(F.count(F.lit(1)) / F.lit(p.block))
    slices = F.ceil((2 * F.sum("size") / nb + 4 * F.max("size")) / F.lit(p.span))  # two mean blocks, and some long sets by chance
    divided = groups.join(exact.select("sid", "size"), groups.node == F.col("sid")).groupBy("component").agg(nb.cast("int").alias("nb"), slices.cast("int").alias("slices"))
    g = groups.join(divided, "component").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    g = g.join(exact, g.node == exact.sid).select("component", "nb", "slices", "blk", "sid", "copies", "size", "grams")
    g = g.mapInArrow(_cut, "component long, nb int, slices int, blk int, sid long, copies long, size int, grams array<long>, slice int")
    g = g.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    g = g.select("component", F.least(own, F.col("other")).alias("i"), F.greatest(own, F.col("other")).alias("j"), "slice", "slices", "sid", "blk", "copies", "size", "grams")
    g = g.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "slice", "sid")
    return g.mapInArrow(lambda batches: _exactly(batches, p), "a long, b long, n long, best double")


def join(docs: DataFrame, p: Join = Join()) -> DataFrame:
    """``doc_id, class_id, links, jaccard``: the self-join of the documents, a row each.

    ``links`` is the number of other documents that are similar to the document (copies
    among them), ``jaccard`` the greatest of those similarities (null where there is
    none); ``class_id`` is the least id of the documents that links connect with it, its
    own where there are none. Texts without words are similar to none; a text of fewer
    than ``n`` words is the set of one gram. Rows without an id are left out; rows that
    repeat an id and a text count once, an id with several texts has a row for each.
    Texts are read wholly, other columns left aside. An empty table gives an empty result.
    """
    d = pick(docs, doc_id="long", text="string").filter("doc_id is not null")
    sigs = table(signatures(d, p.n), "signatures")
    members = table(sigs.select("sid", "doc_id").distinct(), "members")
    copies = members.groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"))
    sets = table(sigs.groupBy("sid").agg(F.first("sig").alias("sig")).join(copies, "sid"), "sets")
    found = table(links(sets.select("sid", "sig"), p), "links")
    need = table(found.select(F.col("a").alias("sid")).union(found.select("b")).distinct().join(sets.select("sid", "rep", "copies"), "sid"), "linked")
    exact = gram_sets(d.join(need.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), p.n)
    exact = table(exact.groupBy("sid").agg(F.first("grams").alias("grams")).withColumn("size", F.size("grams")).join(need.select("sid", "copies"), "sid"), "exact")

    one, two = exact.select(F.col("sid").alias("a"), F.col("grams").alias("ga")), exact.select(F.col("sid").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    verified = found.filter("not sure").join(one, "a").join(two, "b").filter(both >= p.threshold * (F.size("ga") + F.size("gb") - both))
    kept = table(verified.select("a", "b").unionByName(found.filter("sure").select("a", "b")), "kept")
    rows = table(similar(connected_components(kept, "a", "b"), exact, p), "similar")
    stats = rows.groupBy("a").agg(F.sum("n").alias("n"), F.max("best").alias("best")).withColumnRenamed("a", "sid")
    groups = connected_components(rows, "a", "b").toDF("sid", "g")
    near = table(stats.join(groups, "sid").join(need.select("sid", "rep"), "sid"), "near")
    least = near.groupBy("g").agg(F.min("rep").alias("least"))
    near = near.join(least, "g").select("sid", "n", "best", "least")

    out = members.join(copies, "sid").join(near, "sid", "left").select(
        "doc_id",
        F.coalesce("least", "rep").alias("class_id"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("best")).alias("jaccard"),
    )
    wordless = d.join(members.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id").distinct()
    return out.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("double").alias("jaccard")))


def deduplicated(docs: DataFrame, p: Join = Join(), sources: str | None = None) -> DataFrame:
    """The documents that are the least of a class of :func:`join`, with their own columns.

    Rows without an id and documents without words stay. Rows that repeat an id stay or go
    together; an id that is the least of one of its texts' classes stays. If ``sources``
    is given, the ``source`` of a document that stays becomes the sorted sources of its
    whole class, joined by that sign. An empty table gives an empty result.
    """
    names = docs.columns
    own = {c.lower(): c for c in names}
    classes = table(join(docs, p), "classes")
    gone, key, every = fresh(docs, "gone", "key", "every")
    least = classes.filter("doc_id = class_id").select("doc_id")
    drop = classes.filter("doc_id <> class_id").join(least, "doc_id", "left_anti").select("doc_id").distinct()
    out = docs.join(table(drop, "dropped").toDF(gone), col(own["doc_id"]).cast("long") == F.col(gone), "left_anti")
    if sources is None or "source" not in own:
        return out
    several = classes.filter("links > 0").select("doc_id", "class_id").join(pick(docs, doc_id="long", source="string"), "doc_id")
    several = several.groupBy("class_id").agg(F.array_join(F.array_sort(F.collect_set("source")), sources).alias("s")).filter("s <> ''").toDF(key, every)
    out = out.join(several, col(own["doc_id"]).cast("long") == F.col(key), "left")
    new = F.coalesce(F.col(every), col(own["source"]).cast("string")).cast(docs.schema[own["source"]].dataType)
    return out.select(*[new.alias(c) if c.lower() == "source" else col(c) for c in names])
