import random
from collections import Counter, defaultdict
from math import exp, log, sqrt

import numpy as np
import pytest
from llm.fixtures import WORDS, frame, prose, rows
from pyspark.sql import functions as F

from sparkloom.llm import gbt, kernels, langid, pii, quality, shards, toxicity, urls

SF = "/root/testdata/sf0.01"


# --- quality rules ---------------------------------------------------------------


def kneser_ney(texts: list[str], order: int = 5):
    """Modified Kneser-Ney in dictionaries, without a floor: ``(symbols) -> log p``."""
    grams = Counter()
    for t in texts:
        s = ["\0"] * (order - 1) + list(kernels.spelled(t))
        grams.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    counts = {order: grams}
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    by = {}
    for o, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        d = quality.discounts(*n)
        den, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, v in c.items():
            den[g[:-1]] += v
            kinds[g[:-1]][min(v, 3) - 1] += 1
        by[o] = (c, d, den, kinds)
    size = len(counts[1]) + 1

    def p(g: tuple) -> float:
        if not g:
            return 1 / size
        c, d, den, kinds = by[len(g)]
        h = g[:-1]
        if not den[h]:
            return p(g[1:])
        gamma = sum(x * y for x, y in zip(d, kinds[h])) / den[h]
        v = c[g]
        return max(v - (d[min(v, 3) - 1] if v else 0), 0) / den[h] + gamma * p(g[1:])

    def score(t: str) -> float:
        s = ["\0"] * (order - 1) + list(kernels.spelled(t))
        return sum(log(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1)) / len(t)

    return score


def test_perplexity_is_kneser_ney(spark):
    r = random.Random(1)
    texts = [prose(r, r.randint(5, 60)) for _ in range(60)] + ["zq", "東京 tower"]
    got = {x.doc_id: x for x in quality.quality(frame(spark, rows(texts)), quality.Bands(floor=0.0)).collect()}
    score = kneser_ney(texts)
    for i, t in enumerate(texts):
        assert got[i].perplexity == pytest.approx(exp(-score(t)), rel=1e-4)


def test_rare_grams_count_at_production_parameters(spark):
    """In more than five million characters, what occurs once is scored by its own count."""
    long = " ".join(prose(random.Random(10), 30) for _ in range(130))
    texts = [long] * (5_300_000 // len(long)) + ["Zyqx vug kwopf, zyqx vug jamb."]
    got = {x.doc_id: x.perplexity for x in quality.quality(frame(spark, rows(texts))).collect()}
    score = kneser_ney(texts)
    for i in (0, len(texts) - 1):
        assert got[i] == pytest.approx(exp(-score(texts[i])), rel=1e-4)


def test_bands_reject_junk_and_keep_prose(spark):
    r = random.Random(2)
    junk = ["".join(r.choice("zxqjkvw#%&@") for _ in range(300)) for _ in range(5)] + ["aaaa" * 100]
    texts = [prose(r, r.randint(40, 200)) for _ in range(400)] + junk
    got = {x.doc_id: x for x in quality.quality(frame(spark, rows(texts))).collect()}
    assert not any(got[i].keep for i in range(400, 406))
    assert sum(got[i].keep for i in range(400)) == 400
    for x in got.values():
        assert x.keep == (x.lower <= x.perplexity <= x.upper)
    kept = quality.filtered(frame(spark, rows(texts)))
    assert {x.doc_id for x in kept.collect()} == set(range(400))


def test_bands_are_of_the_language(spark):
    r = random.Random(3)
    data = rows([prose(r, 60) for _ in range(50)], "en") + [(100 + i, "ñandú " * 30 + prose(r, 3), "es", "s", 1, None, None, None, None, None) for i in range(50)]
    got = quality.quality(frame(spark, data)).groupBy("lang").agg(F.countDistinct("lower").alias("n"), F.bool_and("keep").alias("k")).collect()
    assert {x.lang for x in got} == {"en", "es"} and all(x.k for x in got)


def test_discounts():
    assert quality.discounts(0, 1, 1, 1) == (0.5, 1.0, 1.5)
    y = 10 / (10 + 2 * 5)
    assert quality.discounts(10, 5, 3, 2) == pytest.approx((1 - 2 * y * 5 / 10, 2 - 3 * y * 3 / 5, 3 - 4 * y * 2 / 3))


# --- language ID -----------------------------------------------------------------


def test_languages_against_exact_sets(spark):
    """The filters decide as exact n-gram sets do."""
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "cc": "mnopqr"}
    r = random.Random(5)
    text = lambda a, n: " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(n))
    data = [(i, text(alphabets[l], r.choice((4, 40, 200))), l, "s", 1, None, None, None, None, None) for i, l in enumerate(["aa", "bb", "cc"] * 40)]
    wrong = (500, text(alphabets["cc"], 100), "aa", "s", 1, None, None, None, None, None)
    got = {x.doc_id: x for x in langid.identify(frame(spark, [*data, wrong])).collect()}
    grams = lambda t: ["".join(x) for x in zip(*[("\0" * 4 + t)[k:] for k in range(5)])]
    sets = defaultdict(set)
    for d in [*data, wrong]:
        sets[d[2]] |= set(grams(d[1]))
    for d in data:
        n = {l: sum(g in s for g in grams(d[1])) for l, s in sets.items()}
        best = max(sorted(n), key=lambda l: n[l])
        assert got[d[0]].lang == best == d[2]
        assert got[d[0]].score == pytest.approx(n[best] / len(d[1]), abs=0.02)
    assert got[500].declared == "aa"


def test_false_positives_are_corrected():
    rng = np.random.default_rng(1)
    own = np.unique(rng.integers(0, 1 << 60, 20_000).astype(np.uint64))
    rows = 3 * len(own)
    filled = np.zeros((1, rows), np.uint8)
    for l, keys in enumerate((own, own[:100])):
        for at in langid.places(keys, rows, 4):
            filled[0][at] |= np.uint8(1 << l)
    b = langid.SlicedBloom(["a", "b"], filled, [int((filled[0] >> l & 1).sum()) for l in (0, 1)], 4)
    other = rng.integers(1 << 61, 1 << 62, 50_000).astype(np.uint64)
    for truth in (0.0, 0.3):
        keys = np.concatenate([other[: int(50_000 * (1 - truth))], rng.choice(own, int(50_000 * truth))])
        n = np.array([float(len(keys))])
        seen = b.popcounts(keys, np.array([0]), np.array([len(keys)]))
        assert abs(b.corrected(seen, n)[0, 0] / n[0] - truth) < 0.02
    assert (b.masks(own)[0] & np.uint8(1)).all()


def test_filter_holds_every_ngram(spark):
    """The rows that Spark writes are those of all n-grams, for more languages than a
    byte has bits; wrongly declared documents do not spoil their language."""
    r = random.Random(15)
    data = [(i, prose(r, 20) + f" {'abcdefghijklmnop'[i % 12] * 6} {i}", f"l{i % 12:02d}", "s", 1, None, None, None, None, None) for i in range(60)]
    data.append((99, "東京都 の 漢字", "l03", "s", 1, None, None, None, None, None))
    d = frame(spark, data).select("doc_id", "lang", "text")
    p = langid.Filter(ratio=0.0)
    langs, made, filled = langid.build(d, p)
    table = shards.opened_rows(made)
    assert langs == sorted({x[2] for x in data}) and table.dtype == np.uint16
    bloom = langid.SlicedBloom(langs, table, filled, p.hashes)
    assert filled == [int((table[0] >> l & 1).sum()) for l in range(12)]
    for x in data:
        cps, _, lens = next(kernels.pieces([kernels.spelled(x[1].lower())], 4))
        keys = kernels.codes(cps, 5)[kernels.inside(lens, 4, len(cps) - 4)]
        assert (bloom.masks(keys)[0] >> np.uint16(langs.index(x[2])) & np.uint16(1)).all()


def test_no_two_characters_are_one():
    texts = ["東京", "京東", chr(0x4E00), chr(0x4F00), chr(0x4E01), "😀", "😁", chr(3328), chr(3327), "é漢", "漢é"]
    spelt = [kernels.spelled(t) for t in texts]
    assert len(set(spelt)) == len(texts) and all(ord(c) < 4096 for t in spelt for c in t)
    assert [len(t) for t in spelt] == [4, 4, 2, 2, 2, 3, 3, 2, 1, 3, 3]


def test_languages_of_the_documents(spark):
    got = langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).filter("declared is not null").collect()
    assert sum(x.lang == x.declared for x in got) > 0.97 * len(got)


# --- personal data ---------------------------------------------------------------


def test_field_on_held_out_examples():
    p = pii.Field()
    hit = miss = false = 0
    for text, gold in pii.examples(pii.Field(sentences=500, seed=99)):
        found = pii.find([text], pii.model(p), p)[0]
        for a, b, l in gold:
            ok = any(s < b and a < e and pii.LABELS[l] == name for s, e, name in found)
            hit, miss = hit + ok, miss + (not ok)
        false += sum(not any(s < b and a < e for a, b, _ in gold) for s, e, _ in found)
    assert hit / (hit + miss) > 0.97 and false < 0.03 * hit


def test_distant_repeats_share_their_label():
    p = pii.Field()
    value = "a7Kp2mQ9zX4c"  # by itself no secret
    text = f'the api_key = "{value}" was set. ' + "river stone " * 400 + f"again {value} here"
    spans = pii.find([text, f"again {value} here"], pii.model(p), p)
    assert [(text[a:b], l) for a, b, l in spans[0]] == [(value, "SECRET")] * 2
    assert spans[1] == []


@pytest.mark.parametrize("n", [5, 40])
def test_many_repeats_share_their_label(n):
    p = pii.Field()
    value = "a7Kp2mQ9zX4c"
    again = ("river stone " * 20 + f"again {value} here ") * n
    for text in (f'the api_key = "{value}" was set. ' + again, again + f'the api_key = "{value}" was set.'):
        assert [(text[a:b], l) for a, b, l in pii.find([text], pii.model(p), p)[0]] == [(value, "SECRET")] * (n + 1)
    assert pii.find([again], pii.model(p), p) == [[]]


def test_marginals_are_exact_on_trees():
    rng = np.random.default_rng(3)
    u, pair = rng.normal(size=(4, 3)), rng.normal(size=(2, 3, 3))
    pair = (pair + pair.transpose(0, 2, 1)) / 2
    links = np.array([(0, 1, 0), (1, 2, 1), (1, 3, 0)])
    want = np.zeros((4, 3))
    for a in np.ndindex(3, 3, 3, 3):
        w = exp(sum(u[i, a[i]] for i in range(4)) + sum(pair[k, a[i], a[j]] for i, j, k in links))
        for i in range(4):
            want[i, a[i]] += w
    want /= want.sum(axis=1, keepdims=True)
    got = pii.marginals(u, links, pair, pii.Field(rounds=60))
    assert np.allclose(got, want, atol=1e-4)


def test_marginals_on_small_loopy_graphs():
    """Labels of the greatest exact marginal, and marginals near the exact ones."""
    rng = np.random.default_rng(4)
    near = same = n = 0
    for _ in range(40):
        k = int(rng.integers(3, 6))
        links = np.array([(i, i + 1, 0) for i in range(k - 1)] + [(0, k - 1, 1)] + ([(0, k - 2, 1)] if k > 3 else []))
        u, pair = 1.5 * rng.normal(size=(k, 3)), np.stack([0.4 * np.eye(3), 1.2 * np.eye(3)])
        want = np.zeros((k, 3))
        for a in np.ndindex(*[3] * k):
            w = exp(sum(u[i, a[i]] for i in range(k)) + sum(pair[c, a[i], a[j]] for i, j, c in links))
            for i in range(k):
                want[i, a[i]] += w
        want /= want.sum(axis=1, keepdims=True)
        got = pii.marginals(u, links, pair, pii.Field())
        near += (abs(got - want) < 0.1).all(axis=1).sum()
        same += (got.argmax(axis=1) == want.argmax(axis=1)).sum()
        n += k
    assert same >= 0.97 * n and near >= 0.9 * n


def test_values_of_letters_and_of_several_tokens():
    p = pii.Field()
    found = lambda t: [(t[a:b], l) for a, b, l in pii.find([t], pii.model(p), p)[0]]
    assert found("password = hunterwombat and later hunterwombat again") == [("hunterwombat", "SECRET")] * 2
    far = "river stone " * 60
    assert found(f"Name: John Smith met us. {far} Then John Smith left.") == [("John Smith", "NAME")] * 2
    assert found("IBAN DE89 3704 0044 0532 0130 00 ok") == [("DE89 3704 0044 0532 0130 00", "IBAN")]
    assert found("IBAN DE89370400440532013000 ok") == [("DE89370400440532013000", "IBAN")]
    assert found("card 4111 1111 1111 1111 ok") == [("4111 1111 1111 1111", "CARD")]
    assert found("He lives at 221b Baker Street in town") == [("221b Baker Street", "ADDRESS")]
    assert found("the key point is that names matter; the street was empty. Dear reader, go on.") == []


def test_equal_texts_have_equal_spans(spark):
    text = "Mail a.b@c.org and a.b@c.org, token = \"a7Kp2mQ9zX4c\"."
    got = [x.spans for x in pii.scan(frame(spark, rows([text, "x", text]))).orderBy("doc_id").collect()]
    assert got[0] == got[2] and len(got[0]) == 3 and got[1] == []


def test_masking_leaves_the_rest_alone(spark):
    text = "Write to anna.b@mail.example.org or call (415) 555-0134 before 2021-03-04. Chapter 12, page 7."
    out = pii.scan(frame(spark, rows([text, "no data here, 12 of 30 apples"]))).orderBy("doc_id").collect()
    assert out[0].text == "Write to [EMAIL] or call [PHONE] before 2021-03-04. Chapter 12, page 7."
    assert out[1].text == "no data here, 12 of 30 apples" and out[1].spans == []
    for s in out[0].spans:
        a, b = map(int, s.split()[0].split("-"))
        assert text[a:b] in ("anna.b@mail.example.org", "(415) 555-0134")
    red = pii.redacted(frame(spark, rows([text]))).first()
    assert red.text == out[0].text and red.n_chars == len(red.text)


# --- boosted trees ---------------------------------------------------------------


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(7)
    X = rng.normal(size=(6000, 6))
    truth = 1 / (1 + np.exp(-3 * (X[:, 0] * X[:, 1] > 0) + 1.5))
    y = (rng.random(6000) < truth).astype(float)
    m = gbt.calibrate(gbt.fit(X[:3000], y[:3000]), X[3000:5000], y[3000:5000])
    q = m.probability(X[5000:])
    assert abs(q - truth[5000:]).mean() < 0.08
    assert (np.diff(m.y) >= 0).all()


def test_isotonic_is_the_best_rising_fit():
    x, y = np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1])
    xs, ys = gbt.isotonic(x, y)
    assert np.interp([1, 2, 3, 4, 5], xs, ys).tolist() == [0, 0.5, 0.5, 0.5, 1]


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = F.xxhash64(F.lit(1), "doc_id") % 2 == 0
    scored = toxicity.score(docs, labels.filter(~out)).withColumnRenamed("toxic", "said").join(labels.filter(out), "doc_id").select("said", "toxic", "toxicity").collect()
    hit = sum(r.said for r in scored if r.toxic)
    assert hit >= 0.9 * sum(r.toxic for r in scored)
    assert sum(r.said for r in scored if not r.toxic) <= 0.01 * len(scored)
    mean = sum(r.toxicity for r in scored) / len(scored)
    assert abs(mean - sum(r.toxic for r in scored) / len(scored)) < 0.03


def test_lexicon_is_of_all_labelled_documents(spark):
    r = random.Random(13)
    toxic = [i % 4 == 0 for i in range(4000)]
    texts = [prose(r, 20) + (" grumblefitz" if t and i < 320 else "") for i, t in enumerate(toxic)] + [None] * 500
    labels = spark.createDataFrame([(i, int(i < 4000 and toxic[i])) for i in range(4500)], "doc_id long, toxic int")
    p = toxicity.Toxic(sample=100)
    _, learnt = toxicity.train(frame(spark, rows(texts)).select("doc_id", "text"), labels, p)
    assert all(x.find(kernels.words(["grumblefitz"])[0])[0] >= 0 for x in shards.opened(learnt))


def test_no_document_is_judged_by_its_own_label(spark):
    """A word whose toxic documents are all of one fold is in no lexicon without it."""
    p = toxicity.Toxic(least=2, z=1.0, ratio=2.0)
    part = toxicity.fold(np.arange(4000), p)
    own = np.flatnonzero(part == 2)[:40].tolist()
    r = random.Random(3)
    texts = [prose(r, 12) + (" grumblefitz" if i in own else "") for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i in own or i % 5 == 0)) for i in range(4000)], "doc_id long, toxic int")
    _, learnt = toxicity.train(frame(spark, rows(texts)).select("doc_id", "text"), labels, p)
    word = kernels.words(["grumblefitz"])[0]
    assert [x.find(word)[0] >= 0 for x in shards.opened(learnt)] == [True, True, False, True, True]


def test_toxic_features():
    learnt = toxicity.lexicon(["grumble"])
    X = toxicity.features(["You GRUMBLE, idiot!!", "a quiet river", "1d1ot", ""], learnt, toxicity.Toxic())
    at = toxicity.NAMES.index
    assert X[0, at("learnt")] == 1 and X[0, at("general")] == 1 and X[0, at("near_you")] == 2 and X[0, at("least_gap")] == 1
    assert X[0, at("exclaim")] > 0 and X[1, : at("near_you")].sum() == 0 and not X[3].any()


def test_urls_on_held_out_labels(spark):
    """Labels come from lexical shape, not from words that the features could read."""
    r = random.Random(9)
    rowsof = []
    for i in range(3000):
        bad = r.random() < 0.4
        host = "-".join(r.choice(WORDS) for _ in range(3)) + str(r.randrange(99)) + ".xyz" if bad else r.choice(WORDS) + ".org"
        tail = "/" + "/".join(str(r.randrange(10**6)) for _ in range(3)) + "?" + "&".join(f"{r.choice('abc')}={r.randrange(999)}" for _ in range(4)) if bad else "/" + r.choice(WORDS)
        rowsof.append((i, f"http://{host}{tail}{'' if bad else i}", int(bad)))
    pages = spark.createDataFrame(rowsof, "page_id long, url string, label int")
    got = urls.score(pages.drop("label"), pages.filter("page_id < 2000").select("url", "label")).join(pages, "page_id").filter("page_id >= 2000").collect()
    assert sum(x.reject == bool(x.label) for x in got) >= 0.98 * len(got)
    X = urls.features(["https://a.b.example.com:80/x/y/?q=1&r=2#f"], {}, 0.5)[0]
    at = urls.NAMES.index
    assert (X[at("depth")], X[at("params")], X[at("labels")], X[at("https")], X[at("port")], X[at("fragment")]) == (3, 2, 4, 1, 1, 1)


def test_suffixes_are_counted_over_all_labels(spark):
    """Most bad suffixes are in no sample; their addresses differ by nothing else."""
    r = random.Random(14)
    data = [(i, f"http://{r.choice(WORDS)}.{'bad' if i % 2 else 'fine'}{i % 400}.org/{r.randrange(10**6):06d}", i % 2) for i in range(16_000)]
    pages = spark.createDataFrame([(i, u.replace("bad", "site").replace("fine", "site"), y) for i, u, y in data], "page_id long, url string, label int")
    got = urls.score(pages.drop("label"), pages.filter("page_id < 14000").select("url", "label"), urls.Urls(sample=300)).join(pages, "page_id").filter("page_id >= 14000").collect()
    assert sum(x.reject == bool(x.label) for x in got) >= 0.95 * len(got)


def test_robust_deviation(spark):
    """The band's width: median absolute deviations, as computed directly."""
    r = random.Random(8)
    data = [("en", r.gauss(-2, 0.1), 100 + i) for i in range(101)]
    got = quality.bands(spark.createDataFrame(data, "lang string, s double, n long"), "lang", "s", "n").first()
    s = np.array([x[1] for x in data])
    n = np.array([x[2] for x in data])
    mid = np.median(s)
    assert got.mid == pytest.approx(mid) and got.wide == pytest.approx(1.4826 * np.median(abs(s - mid)))
    assert got.error == pytest.approx(1.4826 * np.median(abs(s - mid) * np.sqrt(n))) and sqrt(got.wide) > 0
