"""Operators on small graphs, beyond what the SQL of the queries covers."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import curie
from sparkloom.functions.catalog import NS, catalog
from sparkloom.kg import KG
from sparkloom.operators import clique, closure, components, filters, merge, normalize, provenance, summary, validate
from sparkloom.plans import transformer
from sparkloom.streaming import streams

N = "id string, category array<string>, name string, same_as array<string>"
E = "subject string, predicate string, object string"


def graph(spark, nodes, edges) -> KG:
    return KG(spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E))


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f("v").alias("r")).first().r


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (curie.is_curie, "HP:1", True), (curie.is_curie, ":1", True), (curie.is_curie, "a b", False), (curie.is_curie, None, False),
        (curie.is_iri, "http://x/y", True), (curie.prefix_of, "HP:1", "HP"), (curie.reference_of, "HP:1", "1"), (curie.prefix_of, "x", None),
        (curie.camel_to_sentence, "NamedThing", "named thing"), (curie.snake_to_sentence, "named_thing", "named thing"),
        (curie.sentence_to_snake, "Named thing", "named_thing"), (curie.sentence_to_camel, "named thing", "NamedThing"),
        (curie.category_curie, "named thing", f"{NS}:NamedThing"), (curie.slot_curie, "related to", f"{NS}:related_to"),
    ],
)
def test_names(spark, f, value, want):
    assert one(spark, value, f) == want


def test_contract_takes_the_longest_prefix(spark):
    px = {"A": "http://x/", "B": "http://x/b#", "C": "http://x/b", "D": "http://y.z/(q)_"}
    got = {v: one(spark, v, lambda c: curie.contract(c, px)) for v in ("http://x/1", "http://x/b#1", "http://x/bc", "http://y.z/(q)_7", "http://yaz/(q)_7", "other", "")}
    assert list(got.values()) == ["A:1", "B:1", "C:c", "D:7", "http://yaz/(q)_7", "other", ""]
    assert one(spark, None, lambda c: curie.contract(c, px)) is None
    assert one(spark, "http://x/1", lambda c: curie.contract(c, px, {"http://x/1": "Z:1"})) == "Z:1"
    assert one(spark, "B:1", lambda c: curie.expand(c, px)) == "http://x/b#1" and one(spark, "Q:1", lambda c: curie.expand(c, px)) == "Q:1"


def test_catalog():
    c = catalog()
    assert c.ancestors("Gene")[0] == "Gene" and "NamedThing" in c.ancestors("Gene")
    assert c.ancestors("NoSuchClass") == []


def test_components(spark):
    pairs = [("b", "a"), ("b", "c"), ("d", "d"), ("e", "f"), ("f", "e"), ("a", "b"), (None, "z")] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
    got = dict(components.connected_components(spark.createDataFrame(pairs, "x string, y string"), "x", "y").collect())
    assert [got[k] for k in "abcdef"] == ["a", "a", "a", "d", "e", "e"] and {got[f"p{i:02}"] for i in range(41)} == {"p00"} and "z" not in got
    assert components.connected_components(spark.createDataFrame([], "x string, y string"), "x", "y").collect() == []


def test_closure_with_a_cycle(spark):
    g = graph(spark, [], [("a", "subclass_of", "b"), ("b", "subclass_of", "c"), ("c", "subclass_of", "a"), ("c", "subclass_of", "d"), ("x", "other", "y")])
    got = {(r.id, r.ancestor): r.distance for r in closure.ancestors(g).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "d"): 2, ("c", "a"): 1, ("c", "b"): 2, ("c", "d"): 1}
    some = closure.ancestors(g, spark.createDataFrame([("b",)], "id string")).collect()
    assert {(r.id, r.ancestor) for r in some} == {("b", "a"), ("b", "c"), ("b", "d")}


def test_clique_merge(spark):
    gene, disease = [f"{NS}:Gene"], [f"{NS}:Disease"]
    nodes = [("HGNC:1", gene, "one", None), ("ENSEMBL:1", gene, None, ["HGNC:1"]), ("MONDO:1", disease, "d", ["HGNC:1"]), ("X:9", gene, "alone", None)]
    edges = [("ENSEMBL:1", f"{NS}:same_as", "NCBIGene:1"), ("NCBIGene:1", f"{NS}:related_to", "X:9"), ("X:9", f"{NS}:related_to", "ENSEMBL:1")]
    out = clique.clique_merge(graph(spark, [*nodes, ("NCBIGene:1", gene, "n", None)], edges), priority=["HGNC", "NCBIGene", "ENSEMBL"])
    n = {r.id: r for r in out.nodes.collect()}
    assert set(n) == {"HGNC:1", "MONDO:1", "X:9"} and n["HGNC:1"].same_as == ["ENSEMBL:1", "NCBIGene:1"] and n["HGNC:1"].clique_leader
    e = {(r.subject, r.object): r for r in out.edges.collect()}
    assert set(e) == {("HGNC:1", "X:9"), ("X:9", "HGNC:1")} and e["HGNC:1", "X:9"]._original_subject == "NCBIGene:1"


def test_merge_keeps_all_values_of_other_properties(spark):
    a = KG(spark.createDataFrame([("1", "n1", "p", ["x"])], "id string, name string, note string, synonym array<string>"), spark.createDataFrame([], E))
    b = KG(spark.createDataFrame([("1", "n2", "q", ["y", "x"]), ("2", "m", None, None)], "id string, name string, note string, synonym array<string>"), spark.createDataFrame([], E))
    got = {r.id: r for r in merge.merge([a, b]).nodes.collect()}
    assert (got["1"].name, got["1"].note, got["1"].synonym) == ("n1", ["p", "q"], ["x", "y"]) and got["2"].name == "m"
    assert {r.id: r.note for r in merge.merge([a, b], preserve=False).nodes.collect()} == {"1": "q", "2": None}


def test_filters_imply_each_other(spark):
    f = filters.Filters.of({"category": {f"{NS}:Gene"}}, {"subject_category": {f"{NS}:Disease"}, "predicate": {f"{NS}:x"}})
    assert f.nodes["category"] == {f"{NS}:Gene", f"{NS}:Disease"} and f.edges["object_category"] == {f"{NS}:Gene"}
    with pytest.raises(TypeError):
        filters.Filters.of({"category": [f"{NS}:Gene"]})
    assert filters.sql_where({"id": "a'b"}) == "\"id\" IN ('a''b')"


def test_provenance(spark):
    df = spark.createDataFrame([("Some DB. (v1)", None)], "knowledge_source string, subject string")
    got = provenance.Provenance({"knowledge_source": True, "aggregator_knowledge_source": "agg"}).edges(df).first()
    assert got.knowledge_source == "infores:some-db--v1" and got.aggregator_knowledge_source == ["agg"]
    assert provenance.Provenance({"knowledge_source": ("DB.*", "", "by")}).edges(df).first().knowledge_source == "infores:by-some"


def test_import_rules(spark):
    df = spark.createDataFrame([("a|b||a", "x|y", "False", " ", 5)], "synonym string, other string, negated string, blank string, n int")
    got = normalize.sanitize_import(df).first()
    assert (got.synonym, got.other, got.negated, got.blank, got.n) == (["a", "b"], ["x", "y"], True, None, "5")


def test_validation(spark):
    g = graph(spark, [("X:1", [f"{NS}:Gene"], "a", None), ("bad id", [f"{NS}:gene"], None, None)], [("X:1", f"{NS}:BAD", "Y:1")])
    kinds = {(r.entity, r.kind) for r in validate.validate(g, prefixes={"X"}).collect()}
    assert ("bad id", "INVALID_NODE_PROPERTY_VALUE") in kinds and ("bad id", "INVALID_CATEGORY") in kinds and ("X:1-Y:1", "INVALID_EDGE_PREDICATE") in kinds
    assert not any(e == "X:1" for e, _ in kinds)


def test_summary_counts_the_unknown(spark):
    g = graph(spark, [("X:1", [f"{NS}:Gene", f"{NS}:NamedThing"], "a", None), ("Y:1", None, None, None)], [("X:1", f"{NS}:related_to", "Y:1"), ("X:1", None, "Z:1")])
    s = summary.graph_summary(g)
    assert s["node_stats"]["count_by_category"]["unknown"]["count"] == 1 and s["node_stats"]["count_by_id_prefixes"] == {"X": 2, "Y": 1}
    assert s["edge_stats"]["count_by_spo"][f"{NS}:Gene-{NS}:related_to-unknown"]["count"] == 1 and s["edge_stats"]["total_edges"] == 1


def test_streamed_upserts(spark, tmp_path):
    schema = "subject string, predicate string, object string, edge_key string, v string, seq long"
    each = streams.upsert_batches(f"{tmp_path}/table")
    for rows in ([("a", "p", "b", "k", "1", 1), ("a", "p", "b", "k", None, 9)], [("a", "p", "b", "k", "2", 2), ("c", "p", "d", "k", "1", 3)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        streams.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", each=each, checkpoint=f"{tmp_path}/c")
        got = {(r.subject, r.v) for r in streams.upserts(spark, f"{tmp_path}/table").collect()}
    assert got == {("a", "2"), ("c", "1")}


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 01:10:00", "x")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in streams.windowed(df, "t", "k").collect()) == [1, 2]


def test_operations_reject_unknown_arguments(spark):
    g = graph(spark, [("X:1", [f"{NS}:Gene"], "a", None)], [("X:1", f"{NS}:related_to", "X:1")])
    with pytest.raises(ValueError, match="category_maping"):
        transformer.operate(g, [{"name": "clique_merge", "args": {"category_maping": {}}}])
    with pytest.raises(ValueError, match="unknown operation"):
        transformer.operate(g, [{"name": "no_such_thing"}])


def test_settings_and_model_versions(tmp_path):
    from sparkloom import config

    (tmp_path / "s.json").write_text('{"level": "ERROR", "prefixes": {"X": "http://x.org/"}}')
    assert config.logger("t", str(tmp_path / "s.json")).level == 40 and config.jsonld_context(str(tmp_path / "s.json"))["X"] == "http://x.org/"
    for n, text in (("classes", '{"Thing": {}}'), ("prefixes", "{}"), ("model", '{"extra_prefixes": {"Y": "http://y.org/"}, "predicates": ["knows"], "version": "9"}')):
        (tmp_path / f"{n}.json").write_text(text)
    other = catalog(str(tmp_path))
    assert other.version == "9" and other.predicates == ("knows",) and other.prefixes == {"Y": "http://y.org/"} and catalog().version != "9"
