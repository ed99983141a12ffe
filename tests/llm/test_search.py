import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import spark_rows, sql_rows
from llm.fixtures import frame, prose, rows

from sparkloom.llm import chosenpath, kernels, topk
from sparkloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_topk_matches_sql(spark):
    assert spark_rows(QUERIES["op5_topk_search"](spark, SF)) == sql_rows(ORACLES["op5_topk_search"], SF)


def test_topk_ties_go_to_the_least_id(spark):
    docs = frame(spark, rows(["river stone"] * 15 + ["river", "stone lamp"]))
    q = spark.createDataFrame([(7, "stone river")], "item_id long, text string")
    got = topk.search(docs, q).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(10)) and [r["rank"] for r in got] == list(range(1, 11))


def test_topk_of_words_that_weigh_nothing(spark, tmp_path):
    """A word of (nearly) every document has weight 0; its documents count all the same."""
    docs = frame(spark, rows([f"alpha beta{i}" for i in range(1200)]))
    q = spark.createDataFrame([(1, "alpha"), (2, "beta7 alpha"), (3, "gamma")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    q.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sql_rows(ORACLES["op5_topk_search"], str(tmp_path))
    assert len(want[1]) == 20 and spark_rows(QUERIES["op5_topk_search"](spark, str(tmp_path))) == want


def gram_set(text: str, n: int = 3) -> frozenset:
    w = [text.lower()[s:e] for _, _, s, e in zip(*kernels.words([text]))]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(texts: list, threshold: float) -> set:
    sets = [(i, gram_set(t)) for i, t in enumerate(texts) if t and gram_set(t)]
    return {(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if len(s & t) >= threshold * len(s | t)}


def classes(n: int, pairs: set) -> list[int]:
    """The least member of each one's connected group."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]


def edited(r: random.Random, text: str, share: float) -> str:
    w = text.split()
    for i in range(len(w)):
        if r.random() < share:
            w[i] = r.choice(("alpha", "beta", "gamma")) + str(r.randrange(1000))
    return " ".join(w)


def near_copies(seed: int) -> list[str]:
    r = random.Random(seed)
    texts = []
    for g in range(60):
        base = " ".join(f"w{r.randrange(500)}" for _ in range(r.choice((20, 60, 150))))
        texts += [base] + [edited(r, base, r.choice((0, 0.01, 0.03, 0.06, 0.1))) for _ in range(r.choice((0, 1, 3, 6)))]
    base = " ".join(f"v{r.randrange(500)}" for _ in range(80))
    texts += [edited(r, base, 0.04) for _ in range(150)] + [base] * 30  # more than a bucket
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [512, 16])
def test_join_against_brute_force(spark, block):
    texts = near_copies(1)
    want = brute(texts, 0.5)
    got = {r.doc_id: r for r in chosenpath.join(frame(spark, rows(texts)), chosenpath.Join(block=block)).collect()}
    assert sorted(got) == list(range(len(texts)))
    links, best = Counter(x for pair in want for x in pair), defaultdict(float)
    sets = [gram_set(t) for t in texts]
    for a, b in want:
        jac = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        best[a], best[b] = max(best[a], jac), max(best[b], jac)
    assert all(r.links <= links[i] for i, r in got.items())
    assert sum(r.links for r in got.values()) >= 0.97 * 2 * len(want)
    own = classes(len(texts), want)
    assert sum(r.class_id == own[i] for i, r in got.items()) >= 0.98 * len(texts)
    for i, r in got.items():
        assert (r.jaccard is None) == (r.links == 0) and (r.class_id == i or r.links)
        assert r.links < links[i] or r.links == 0 or abs(r.jaccard - best[i]) < 1e-6


def test_join_in_slices(spark):
    """How the sets are divided into blocks and slices doesn't show in the result."""
    docs = frame(spark, rows(near_copies(3)))
    got = [sorted(map(tuple, chosenpath.join(docs, chosenpath.Join(block=16, span=span)).collect()), key=str) for span in (1 << 18, 500)]
    assert got[0] == got[1] and sum(r[2] for r in got[0]) > 0


def test_long_sets_are_compared_in_little_memory():
    """Sets of 200 near copies of a long text, of 3 million grams in all, two short ones and one of another text."""
    r = np.random.default_rng(1)
    base, sets = r.integers(0, 1 << 63, 15_000, np.uint64) << np.uint64(1), []
    for _ in range(200):
        other = r.random(len(base)) < 0.1
        sets.append(np.unique(np.where(other, r.integers(0, 1 << 63, len(base), np.uint64), base)))
    sets += [base[:40], base[:50], r.integers(0, 1 << 63, 15_000, np.uint64)]
    sets, slices, k = [np.unique(s) for s in sets], 40, len(sets)
    whole = pa.RecordBatch.from_pydict(
        {c: pa.array([0] * k, pa.int64()) for c in ("component", "i", "j", "blk")}
        | {"slices": pa.array([slices] * k, pa.int32()), "sid": pa.array(range(k)), "copies": pa.array([1] * (k - 1) + [7]), "size": pa.array([len(s) for s in sets], pa.int32())}
        | {"grams": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}
    )
    cut = pa.Table.from_batches(chosenpath._cut([whole]))
    assert cut.num_rows == slices * k and sorted(cut["grams"].combine_chunks().flatten().to_pylist()) == sorted(np.concatenate(sets).view(np.int64).tolist())
    batches = cut.sort_by([("slice", "ascending"), ("sid", "ascending")]).to_batches(max_chunksize=150)  # a slice goes over two batches
    tracemalloc.start()
    got = {a: (n, best) for b in chosenpath._exactly(batches, chosenpath.Join()) for a, n, best in zip(*(b.column(c).to_pylist() for c in ("a", "n", "best")))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    assert sorted(got) == list(range(202)) and all(got[a][0] == 199 for a in range(200)) and got[200] == got[201] == (1, 0.8)
    best = max(len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s)) for s in sets[1:])
    assert abs(got[0][1] - best) < 1e-9


def test_join_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.select("doc_id", "text").orderBy("doc_id").collect()
    texts, ids = [r.text for r in own], [r.doc_id for r in own]
    want = brute(texts, 0.5)
    links = Counter(ids[x] for pair in want for x in pair)
    group = {ids[i]: ids[g] for i, g in enumerate(classes(len(texts), want))}
    got = QUERIES["op3_ngram_join"](spark, SF).collect()
    assert want and sorted(r.doc_id for r in got) == ids
    assert all(r.links <= links[r.doc_id] for r in got) and sum(r.links for r in got) >= 0.97 * 2 * len(want)
    assert sum(r.class_id == group[r.doc_id] for r in got) >= 0.98 * len(ids)


def test_join_on_repeats_and_texts_without_words(spark):
    r = random.Random(6)
    t = prose(r, 30)
    data = rows([t, t, None, "", "  ", "one word", t.replace(".", " lamp.")])
    data += [data[0], data[0], (3, "an id with another text", "en", "s", 1, None, None, None, None, None), (None, t, "en", "s", 1, None, None, None, None, None)]
    got = sorted((x.doc_id, x.class_id, x.links, x.jaccard) for x in chosenpath.join(frame(spark, data)).collect() if x.links)
    assert [x[:3] for x in got] == [(0, 0, 2), (1, 0, 2), (6, 0, 2)] and [x[3] for x in got[:2]] == [1, 1] and 0.9 < got[2][3] < 1
    alone = sorted((x.doc_id, x.class_id, x.links) for x in chosenpath.join(frame(spark, data)).collect() if not x.links)
    assert alone == [(i, i, 0) for i in (2, 3, 4, 5)]


def test_deduplication_keeps_one_of_each_group(spark):
    texts = near_copies(2)
    groups = set(classes(len(texts), brute(texts, 0.5)))
    data = [(*x[:3], f"s{x[0] % 3}", *x[4:]) for x in rows(texts)]
    out = chosenpath.deduplicated(frame(spark, data), sources="+").collect()
    kept = [r.doc_id for r in out]
    assert len(kept) == len(set(kept)) and groups <= set(kept)
    assert len(kept) <= 1.02 * len(groups)
    of = defaultdict(set)
    for i, g in enumerate(classes(len(texts), brute(texts, 0.5))):
        of[g].add(f"s{i % 3}")
    assert sum(r.source == "+".join(sorted(of[r.doc_id])) for r in out) >= 0.97 * len(out)


def test_words_and_grams():
    h, row, s, e = kernels.words(["Ab c_d 東京!", "", "AB"])
    assert [(int(r), int(a), int(b)) for r, a, b in zip(row, s, e)] == [(0, 0, 2), (0, 3, 6), (0, 7, 8), (0, 8, 9), (2, 0, 2)]
    assert h[0] == h[4]
    g, grow, first = kernels.grams(h, row, 3)
    assert grow.tolist() == [0, 0, 2] and first.tolist() == [0, 1, 4]


def test_hash_array():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    a = kernels.HashArray(keys, np.arange(len(keys)))
    assert (a.v[a.find(keys)] == np.arange(len(keys))).all()
    assert (a.find(keys + np.uint64(1)) == -1).sum() >= len(keys) - 2


def test_a_text_is_counted_wholly_where_it_is_divided():
    r = random.Random(2)
    t = prose(r, 400)
    for size in (7, 64, 10_000):
        got = [np.sort(c[kernels.inside(n, 4, len(c))]) for cps, _, n in kernels.pieces([t, "abc"], 4, size) for c in [kernels.codes(cps, 5)]]
        assert sum(map(len, got)) == len(t) + 3
        one = np.sort(np.concatenate(got))
        if size == 7:
            first = one
        assert (one == first).all()
