import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.fixtures import frame, prose, rows

from sparkloom.llm import licenses, mixing, packing
from sparkloom.llm.kernels import words
from sparkloom.llm.license_texts import TEMPLATES

# --- mixing ----------------------------------------------------------------------


def best_flow(patterns: dict, quotas: dict, repeats: int) -> tuple[int, int]:
    """``(tokens routed, least cost)`` by trying all whole allotments; layer r costs r."""
    arcs = [(m, s) for m in patterns for s in m]
    best = (0, 0)
    for x in itertools.product(*[range(min(patterns[m] * repeats, quotas[s]) + 1) for m, s in arcs]):
        used, got = Counter(), Counter()
        for (m, s), v in zip(arcs, x):
            used[m] += v
            got[s] += v
        if any(used[m] > patterns[m] * repeats for m in patterns) or any(got[s] > q for s, q in quotas.items()):
            continue
        cost = sum(r for m, c in patterns.items() for r in range(1, repeats + 1) for _ in range(max(0, min(c, used[m] - (r - 1) * c))))
        best = min(best, (-sum(x), cost))
    return -best[0], best[1]


def test_flow_is_the_cheapest():
    r = random.Random(6)
    for _ in range(25):
        sets = r.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)], 3)
        patterns = {m: r.randint(1, 3) for m in sets}
        p = mixing.Mix(weights={s: r.randint(1, 4) for s in "abc"}, budget=r.randint(2, 7), repeats=2)
        sizes = defaultdict(int)
        for m, c in patterns.items():
            for s in m:
                sizes[s] += c
        quotas = mixing.quotas(sizes, p, p.budget)
        routed = mixing.solve(patterns, p)
        used = {m: sum(f for _, f in routed.get(m, [])) for m in patterns}
        got = Counter()
        for flows in routed.values():
            for s, f in flows:
                got[s] += f
        assert all(got[s] <= q for s, q in quotas.items())
        cost = sum(x for m, c in patterns.items() for x in range(1, 3) for _ in range(max(0, min(c, used[m] - (x - 1) * c))))
        assert (sum(used.values()), cost) == best_flow(patterns, quotas, 2)


def mixed_documents() -> list[tuple]:
    r = random.Random(7)
    data = []
    for i in range(600):
        s = r.choice("aaabbc")
        t = prose(r, r.randint(5, 40))
        data.append((i, t, "en", s, len(t), None, None, None, None, None))
        if r.random() < 0.2:
            data.append((1000 + i, t, "en", r.choice("abc"), len(t), None, None, None, None, None))
    return data


def test_selection_meets_the_targets(spark):
    data = mixed_documents()
    weights = {"a": 0.2, "b": 0.3, "c": 0.5}
    p = mixing.Mix(weights=weights, budget=20_000)
    got = mixing.selection(frame(spark, data), p).collect()
    sources = defaultdict(set)
    first, size = {}, {}
    for i, t, _, s, *_ in data:
        sources[t].add(s)
        first[t] = min(first.get(t, i), i)
        size[t] = len(t.split())
    text = {i: t for i, t, *_ in data}
    tokens, uses = Counter(), Counter()
    for x in got:
        assert first[text[x.doc_id]] == x.doc_id and x.source in sources[text[x.doc_id]] and x.tokens == size[text[x.doc_id]]
        tokens[x.source] += x.uses * x.tokens
        uses[x.doc_id] += x.uses
    for s, w in weights.items():
        assert abs(tokens[s] - w * p.budget) <= 40 * 8
    assert max(uses.values()) <= p.repeats + 1
    again = mixing.selection(frame(spark, list(reversed(data))).repartition(3), p).collect()
    assert sorted(again) == sorted(got)
    assert sorted(mixing.selection(frame(spark, data), mixing.Mix(weights=weights, budget=20_000, bits=3)).collect()) == sorted(got)


def test_selected_amounts_against_a_loop(spark):
    """Every document's uses, counted by walking along each pattern's line."""
    data = mixed_documents()
    p = mixing.Mix(weights={"a": 1, "b": 1, "c": 3}, budget=30_000)
    units = mixing.units(frame(spark, data)).selectExpr("doc_id", "pattern", "tokens", f"xxhash64({p.seed}, doc_id) as u").collect()
    lines = defaultdict(list)
    for x in units:
        lines[tuple(x.pattern)].append((x.u, x.doc_id, x.tokens))
    want = Counter()
    for m, flows in mixing.solve({m: sum(t for _, _, t in v) for m, v in lines.items()}, p).items():
        line, at, lo = sorted(lines[m]), 0, 0
        bounds = []
        for s, f in flows:
            bounds.append((lo, lo + f, s))
            lo += f
        for k in itertools.count():
            _, i, t = line[k % len(line)]
            if at >= lo:
                break
            want[i, next(s for a, b, s in bounds if a <= at < b)] += 1
            at += t
    got = {(x.doc_id, x.source): x.uses for x in mixing.selection(frame(spark, data), p).collect()}
    assert got == dict(want)
    out = mixing.mixed(frame(spark, data), p).collect()
    assert Counter((x.doc_id, x.source) for x in out) == want


# --- packing ---------------------------------------------------------------------


def best_cost(total: list[int], penalty: list[int], window: int) -> int:
    P, cost = [0, *total], [0]
    for j in range(1, len(P)):
        cost.append(min(cost[i] + window - (P[j] - P[i]) for i in range(j) if P[j] - P[i] <= window) + penalty[j - 1])
    return cost[-1]


def test_cuts_cost_least():
    r = random.Random(3)
    for _ in range(300):
        p = packing.Pack(window=r.choice((5, 10, 30)))
        n = r.randint(1, 40)
        total = np.cumsum([r.randint(1, p.window) for _ in range(n)]).tolist()
        penalty = [r.choice((0, 0, 3, 20)) for _ in range(n)]
        ends = packing.cuts(total, penalty, p)
        assert ends[-1] == n - 1 and ends == sorted(set(ends))
        P, at, cost = 0, 0, 0
        for j in ends:
            assert total[j] - P <= p.window
            cost += p.window - (total[j] - P) + penalty[j]
            P = total[j]
        assert cost == best_cost(total, penalty, p.window)


def test_windows_hold_every_word_in_order(spark):
    r = random.Random(4)
    texts = [" ".join(prose(r, r.randint(3, 25)) for _ in range(r.randint(0, 12))) for _ in range(120)] + ["no stop " * 90, " ", ""]
    p = packing.Pack(window=64, shard=9000)
    got = packing.packed(frame(spark, rows(texts)), p).orderBy("shard", "window").collect()
    assert " ".join(x.text for x in got).split() == " ".join(texts).split()
    back = defaultdict(str)
    for x in got:
        assert x.tokens == len(x.text.split()) <= 64 and x.padding == 64 - x.tokens
        assert x.text == "\n\n".join(texts[i][int(a) : int(b)] for i, (a, b) in zip(x.doc_ids, (s.split("-") for s in x.spans)))
        for i, s in zip(x.doc_ids, x.spans):
            back[i] += texts[i][int(s.split("-")[0]) : int(s.split("-")[1])]
    assert all(back[i] == t for i, t in enumerate(texts) if t.strip())


@pytest.mark.parametrize("place", ["close", "wide", "negative", "huge"])
def test_spacing_of_ids_does_not_matter(spark, place):
    r = random.Random(5)
    texts = [prose(r, 3) for _ in range(2000)]
    at = {"close": lambda i: i, "wide": lambda i: i * 1_000_003, "negative": lambda i: i - 1000, "huge": lambda i: (1 << 63) - 1 - 7 * (2000 - i)}[place]
    d = spark.createDataFrame([(at(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = packing.packed(d, packing.Pack(shard=20_000)).orderBy("shard", "window").collect()
    assert " ".join(x.text for x in got).split() == " ".join(texts).split()
    total = sum(map(len, texts))
    assert len({x.shard for x in got}) == (total - 1) // 20_000 + 1
    assert sum(x.padding for x in got) <= len({x.shard for x in got}) * 2048


def test_equal_rows_share_shards_and_repeats_lie_apart(spark):
    r = random.Random(6)
    same = prose(r, 40)
    d = spark.createDataFrame([(7, same)] * 200 + [(i, prose(r, 40)) for i in range(40)], "doc_id long, text string")
    size = Counter(x.shard for x in packing.packed(d, packing.Pack(window=50, shard=2000)).collect())
    assert len(size) > 20 and max(size.values()) <= 30
    twice = spark.createDataFrame([(i, t) for i, t in enumerate(prose(r, 30) for _ in range(50)) for _ in range(2)], "doc_id long, text string")
    got = packing.packed(twice, packing.Pack(window=64, shard=3000, spread=True)).orderBy("shard", "window").collect()
    order = list(dict.fromkeys((k, i) for k, x in enumerate(got) for i in x.doc_ids))
    assert all(len(set(x.doc_ids)) == len(x.doc_ids) for x in got)
    assert list(dict.fromkeys(i for _, i in order)) == list(range(50))
    half = next(n for n, (_, i) in enumerate(order) if i == 49)  # the last one comes before any is repeated
    assert {i for _, i in order[: half + 1]} == set(range(50)) and {i for _, i in order[half + 1 :]} >= set(range(49))


def test_scripts_without_spaces_have_tokens():
    tokens, chars, penalty = packing.boundaries("東京は晴れ。abc def", packing.Pack())
    assert (tokens, chars, penalty) == ([6, 8], [6, 13], [64, 0])
    got = packing.pack_shard([1], ["日本語の文章。" * 1500], packing.Pack(window=100))
    assert "".join(x[0] for x in got) == "日本語の文章。" * 1500
    assert all(x[3] == len(x[0]) == 98 for x in got[:-1]) and sum(x[3] for x in got) == 10_500


def test_boundaries_are_sentence_ends():
    tokens, chars, penalty = packing.boundaries('One two. "Three four?" Five\nsix', packing.Pack())
    assert tokens == [2, 4, 5, 6] and penalty == [64, 64, 64, 0]
    t = 'One two. "Three four?" Five\nsix'
    assert [t[:c].split() for c in chars][1] == ["One", "two.", '"Three', 'four?"']
    long = packing.boundaries("a " * 25, packing.Pack(window=10))
    assert long[0] == [10, 20, 25] and long[2] == [512, 512, 0]


# --- licences --------------------------------------------------------------------


def full_alignment(doc: list, template: list) -> int:
    """Most matched words among best-scoring local alignments, without a band."""
    prev = [(0, 0)] * (len(doc) + 1)
    best = (0, 0)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(doc, 1):
            s, h = prev[j - 1]
            options = [(0, 0), (s + 2, h + 1) if w == t else (s - 1, h), (prev[j][0] - 1, prev[j][1]), (row[-1][0] - 1, row[-1][1])]
            row.append(max(options))
            best = max(best, row[-1])
        prev = row
    return best[1]


def test_planted_licences_are_found(spark):
    r = random.Random(5)
    texts, want = [], []
    for name, body in sorted(TEMPLATES.items()):
        w = body.split()
        texts.append(prose(r, 60) + "\n" + body + "\n" + prose(r, 60))
        want.append((len(texts) - 1, name))
        if len(w) >= 25:
            for i in range(0, len(w), 20):
                w[i] = "changed"
            texts.append(prose(r, 30) + "\n# " + " ".join(w).upper() + "\n" + prose(r, 30))
            want.append((len(texts) - 1, name))
    clean = [prose(r, 200) for _ in range(30)] + ["This software is a game about licences and the rights of cats."]
    got = licenses.scan(frame(spark, rows(texts + clean))).collect()
    found = {(x.doc_id, x.license): x for x in got}
    assert {i for i, _ in want} == {x.doc_id for x in got}
    assert sum(k in found for k in want) >= len(want) - 1
    for (i, name), x in found.items():
        doc = [t.lower() for t in re.findall(r"\w+", texts[i])]
        body = [t.lower() for t in re.findall(r"\w+", TEMPLATES[name])]
        if len(body) < 300:
            assert x.coverage == pytest.approx(full_alignment(doc, body) / len(body), abs=0.03)
        else:
            assert x.coverage >= 0.94
        assert 0 <= x.first < x["last"] <= len(texts[i])


def test_notices_of_like_wording_are_told_apart(spark):
    names = [n for n in TEMPLATES if n.endswith("notice") and len(TEMPLATES[n]) > 200]
    got = {x.doc_id: x.license for x in licenses.scan(frame(spark, rows([prose(random.Random(2), 40) + "\n" + TEMPLATES[n] for n in names]))).collect()}
    assert [got[i] for i in range(len(names))] == names and len(names) >= 5


def test_ties_go_to_the_first_name(spark):
    got = licenses.scan(frame(spark, rows(["the one and only lamp of the house"] * 2)), templates={"b": "one and only lamp", "a": "one and only lamp"}).collect()
    assert [(x.doc_id, x.license, x.coverage) for x in sorted(got)] == [(0, "a", 1), (1, "a", 1)]


def test_a_template_twice_has_two_rows(spark):
    name = "MIT full text"
    r = random.Random(1)
    text = TEMPLATES[name] + "\n" + prose(r, 50) + "\n" + TEMPLATES[name]
    got = licenses.scan(frame(spark, rows([text]))).collect()
    assert [x.license for x in got] == [name, name] and all(x.coverage == 1 for x in got)


def test_every_shared_run_has_a_fingerprint():
    r = np.random.default_rng(2)
    for window in (2, 4, 9):
        row = np.sort(r.integers(0, 20, 500))
        g = r.integers(0, 30, 500).astype(np.uint64)
        keep = set(licenses.fingerprints(g, row, window).tolist())
        for k in range(20):
            own = np.flatnonzero(row == k)
            for a in range(max(1, len(own) - window + 1)):
                w = own[a : a + window]
                if len(w):
                    least = min(g[w])
                    assert max(i for i in w if g[i] == least) in keep


def test_words_of_templates():
    assert all(len(words([t])[0]) >= 3 for t in TEMPLATES.values())
