"""Every operator and stage on awkward and on empty tables."""

import random
from collections import Counter

import pytest
from llm.fixtures import frame, odd_rows, prose, rows

from sparkloom.llm import chosenpath, langid, licenses, mixing, packing, pii, quality, topk, toxicity, urls

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((3, 1, 0), (4, None, None), (None, 1, 1), (5, 1, 1))):
    return spark.createDataFrame(list(rows), LABELS)


ONE = {
    "op1": langid.identify,
    "op2": mixing.selection,
    "op3": chosenpath.join,
    "op4": pii.scan,
    "op7": quality.quality,
    "op8": licenses.scan,
    "op9": packing.packed,
}
STAGES = {"quality": quality.filtered, "dedup": chosenpath.deduplicated, "pii": pii.redacted, "mix": mixing.mixed}
EACH_ROW = ("op1", "op4", "op7")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.mark.parametrize("name", sorted(ONE))
def test_odd_rows(spark, odd, name):
    got = ONE[name](odd).collect()
    if name in EACH_ROW:
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows())
    texts = {(r[0], r[1]) for r in odd_rows() if r[0] is not None}
    if name == "op2":
        assert {r.doc_id for r in got} <= {i for i, t in texts if t and t.strip()} and {r.source for r in got} <= {"s", "t", ""}
        assert all(r.uses > 0 and r.tokens > 0 for r in got) and any(r.doc_id == 5 for r in got)
    elif name == "op3":
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
        assert all((r.class_id, r.links, r.jaccard) == (r.doc_id, 0, None) for r in got)
    elif name == "op8":
        assert got == []
    elif name == "op9":
        words = [w for i, t, *_ in odd_rows() if i is not None and t for w in t.split()]
        assert Counter(w for r in got for w in r.text.split()) == Counter(words) and sum(r.tokens for r in got) == len(words)
        assert all(r.tokens + r.padding == 2048 and r.tokens > 0 for r in got)


@pytest.mark.parametrize("name", sorted(ONE))
def test_empty_table(spark, name):
    assert ONE[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns(spark, odd, name):
    out = STAGES[name](odd)
    assert out.columns == odd.columns
    assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    out.collect()
    assert STAGES[name](frame(spark, [])).collect() == []


def test_toxicity(spark, odd):
    got = toxicity.score(odd, labels(spark)).collect()
    assert len(got) == len(odd_rows())
    assert all(r.toxicity == 0 for r in got if r.doc_id in (0, 1, 2))
    assert toxicity.score(frame(spark, []), labels(spark)).collect() == []
    assert len(toxicity.score(odd, labels(spark, ())).collect()) == len(odd_rows())


def test_equal_texts_and_ties(spark):
    """Equal texts get equal results; of languages with equal counts the first by name."""
    data = [(i, "river stone garden", l, "s", 1, None, None, None, None, None) for i, l in enumerate(["zz", "bb", "aa", None])]
    got = langid.identify(frame(spark, data)).collect()
    assert {r.lang for r in got} == {"aa"} and len({(r.score, r.margin) for r in got}) == 1 and got[0].margin == 0
    r = random.Random(2)
    texts = [prose(r, 12) + (" idiot scum" if i % 3 == 0 else "") for i in range(300)]
    d = frame(spark, rows(texts + texts))
    said = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 0), (1, 1, None), (3, 0, 1)])  # of conflicting labels the toxic one counts
    q = {x.doc_id: x.toxicity for x in toxicity.score(d, said).collect()}
    assert all(q[i] == q[300 + i] for i in range(300)) and q[0] > 0.5 > q[1]


def test_urls(spark):
    data = [(1, None, "x"), (2, "", "x"), (None, "http://a.example/b", None), (3, "http://casino.example/?a=1", "y"), (3, "http://casino.example/?a=1", "y"), (4, "::::%%%", "z"), (5, "http://a/" + "x" * 100_000, "z")]
    pages = spark.createDataFrame(data, "page_id long, url string, label string")
    got = urls.score(pages).collect()
    assert len(got) == 7 and [r.unwanted for r in got if r.page_id in (1, 2)] == [0, 0]
    assert urls.score(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_topk(spark, odd):
    q = spark.createDataFrame([(1, "river stone", 5), (2, None, 5), (3, "", 5), (None, "river", 5), (4, "unheardof", 5), (1, "river stone", 5)], "item_id long, text string, doc_id int")
    got = topk.search(odd, q).collect()
    assert {r.item_id for r in got} == {1} and len({(r.item_id, r["rank"]) for r in got}) == len(got)
    assert topk.search(frame(spark, []), q).collect() == []
    assert topk.search(odd, q.limit(0)).collect() == []
