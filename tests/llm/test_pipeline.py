"""The pipeline's stages on a small corpus with planted cases."""

import random
from collections import Counter

import corpus_pipeline
from llm.fixtures import WORDS, frame, odd_rows, prose

from sparkloom.llm import chosenpath, mixing, packing, quality


def corpus() -> list[tuple]:
    r = random.Random(12)
    texts = [(i, prose(r, r.randint(40, 120)), f"s{i % 3}") for i in range(300)]
    base = texts[5][1]
    near = base.split()
    near[10] = "lantern"
    texts += [(400, base, "s1"), (401, " ".join(near), "s0"), (402, "Mail to jane.d@example.org. " + prose(r, 60), "s0")]
    texts += [(500 + i, "".join(r.choice("zxqjkvw#%&@") for _ in range(300)), "s0") for i in range(4)]
    return [(i, t, "en", s, len(t), "kept", "u", "l", 1, "c") for i, t, s in texts]


def test_stages(spark, tmp_path):
    docs = frame(spark, corpus())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources", "packing"]
    out, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = out.collect()
    ids = {n: Counter(x.doc_id for x in kept[n]) for n in names[:-1]}
    assert set(ids["quality rules"]) == {x[0] for x in corpus()} - {500, 501, 502, 503}
    assert set(ids["quality rules"]) - set(ids["n-gram Jaccard join"]) == {400, 401}
    sources = {x.doc_id: x.source for x in kept["n-gram Jaccard join"]}
    assert sources[5] == "s0\x1fs1\x1fs2" and sources[7] == "s1"  # 5 stands for 400 and 401 too
    masked = {x.doc_id: x.text for x in kept["PII"]}
    assert masked[402].startswith("Mail to [EMAIL]. ") and masked[7] == corpus()[7][1]
    assert set(ids["PII"]) == set(ids["n-gram Jaccard join"])
    chosen = {(x.doc_id, x.source): x.uses for x in mixing.selection(spark.read.parquet(f"{tmp_path}/2"), mixing.Mix(several=corpus_pipeline.SEVERAL)).collect()}
    assert Counter((x.doc_id, x.source) for x in kept["mixing sources"]) == chosen
    words = Counter(w for x in kept["mixing sources"] for w in x.text.split())
    assert Counter(w for x in kept["packing"] for w in x.text.split()) == words
    assert all(x.tokens + x.padding == packing.Pack().window for x in kept["packing"])
    texts = {x.doc_id for x in kept["mixing sources"]}
    assert len(texts) >= 0.9 * len(ids["PII"])  # clean documents stay where sources' sizes are alike
    assert WORDS and quality.Bands()


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    frame(spark, odd_rows()).write.parquet(f"{tmp_path}/a/documents.parquet")
    frame(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert got and {i for x in got for i in x.doc_ids} <= {3, 4, 5, 6, 90}
    assert all(0 < x.tokens <= 2048 and x.tokens + x.padding == 2048 for x in got)
    known = Counter(w for i, t, *_ in odd_rows() if t for w in t.split())
    assert set(w for x in got for w in x.text.split()) <= set(known)
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []


def test_sources_of_copies_reach_the_flow(spark, tmp_path):
    """Texts that the large source shares with the small one fill the small one's quota."""
    r = random.Random(30)
    texts = [prose(r, 50) for _ in range(200)]
    data = [(i, t, "en", "large", 1, None, None, None, None, None) for i, t in enumerate(texts)]
    data += [(1000 + i, t, "en", "small", 1, None, None, None, None, None) for i, t in enumerate(texts[:40])]
    alone = [(2000 + i, prose(r, 50), "en", "small", 1, None, None, None, None, None) for i in range(4)]
    docs = corpus_pipeline.ngram_join(spark, frame(spark, data + alone), str(tmp_path))
    uses = Counter(x.doc_id for x in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).filter("source = 'small'").collect())
    assert sum(n for i, n in uses.items() if i < 40) > 20 and max(uses.values()) <= 2
    without = mixing.mixed(chosenpath.deduplicated(frame(spark, data + alone))).filter("source = 'small'").collect()
    assert {x.doc_id for x in without} == {2000, 2001, 2002, 2003} and max(Counter(x.doc_id for x in without).values()) > 2
