"""Faults that showed on larger tables only, on small ones."""

import json
import os
import tarfile
import xml.etree.ElementTree as ET

import pytest

from pyspark.sql import functions as F
from sparkloom.functions import curie
from sparkloom.functions.catalog import NS
from sparkloom.kg import KG
from sparkloom.operators import clique, merge, normalize, reshape, store, summary
from sparkloom.operators.filters import Filters
from sparkloom.plans import format_queries, transformer
from sparkloom.sinks import databases as db
from sparkloom.sinks import files
from sparkloom.sources import databases, delimited, documents, elements, jsons, rdf
from sparkloom.sources.common import ReadOptions
from sparkloom.streaming import streams


def chain(spark, n: int) -> KG:
    """``n`` nodes in a row, in four partitions."""
    k = F.col("id").cast("string")
    nodes = spark.range(0, n, 1, 4).select(F.concat(F.lit("X:"), k).alias("id"), F.concat(F.lit('it\'s "'), k).alias("name"), F.array(F.lit(f"{NS}:Gene")).alias("category"))
    e = spark.range(0, n, 1, 4).select(F.concat(F.lit("X:"), k).alias("subject"), F.lit(f"{NS}:related_to").alias("predicate"), F.concat(F.lit("X:"), (F.col("id") + 1).cast("string")).alias("object"))
    return KG(nodes, e)


def test_sqlite_parts(spark, tmp_path):
    """any number of records, a file a task."""
    g = chain(spark, 50)
    folder = db.write_sqlite_parts(g, str(tmp_path))
    assert sorted(os.listdir(folder)) == [f"{t}-{i:05d}.sqlite" for t in ("edges", "nodes") for i in range(4)]
    back = databases.load_sqlite(spark, folder)
    assert sorted((r.id, r.name) for r in back.nodes.collect()) == sorted((r.id, r.name) for r in g.nodes.collect())
    assert back.edges.select("subject", "predicate", "object").exceptAll(g.edges).count() == 0 and back.edges.count() == 50


def test_duckdb_parts(spark, tmp_path):
    """A folder of files, whose rows follow each other."""
    g = chain(spark, 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    folder = db.write_duckdb(g, str(tmp_path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(folder) if f.startswith("edges-")]) > 1
    back = databases.load_duckdb(spark, folder, page=3)
    assert sorted(r.id for r in back.nodes.collect()) == sorted(r.id for r in g.nodes.collect()) and back.edges.count() == 50
    by_name = sorted(f"X:{i}" for i in range(50))
    cut = databases.load_duckdb(spark, folder, start=45, end=53)
    assert sorted(r.id for r in cut.nodes.collect()) == by_name[45:] and sorted(r.subject for r in cut.edges.collect()) == by_name[:3]


@pytest.mark.parametrize("block", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_documents_in_blocks(spark, tmp_path, monkeypatch, block, indent):
    """The records of one document, wherever blocks of it end."""
    odd = ['"', "\\", '\\"', "}{][", "é\u2028", '"nodes": [', "", "x" * 90]
    nodes = [{"id": f"N:{i}", "name": t, "meta": {"nodes": [{"id": "inner"}], "v": [[i]]}} for i, t in enumerate(odd)]
    keyed = {f"E:{i}{t}": {"subject": "N:1", "edges": {"a": {"b": t}}} for i, t in enumerate(odd)}
    doc = {"x": {"nodes": [{"id": "other"}]}, "message": {"y": 1, "knowledge_graph": {"nodes": nodes, "edges": keyed}}, "nodes": [{"id": "top"}]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc, indent=indent))
    monkeypatch.setattr(documents, "BLOCK", block)
    wanted = {("message/knowledge_graph/nodes", 3): "nodes", ("message/knowledge_graph/edges", 3): "edges", ("nodes", 1): "nodes"}
    shapes = [documents._shape(str(path), i) for i in range(0, path.stat().st_size, block)]
    got, inside, base, stack = [], 0, 0, []
    for i, s in enumerate(shapes):
        got += documents._taken(str(path), i * block, inside, base, stack, wanted)
        x = s[str(inside)]
        stack = [y for y in stack if y[0] < base + x["least"]] + [(base + d, n, c) for d, n, c in x["open"]]
        inside, base = inside ^ s["flip"], base + x["change"]
    assert [json.loads(t) for r, k, t in got if r == "nodes"] == [*nodes, {"id": "top"}]
    assert {k: json.loads(t) for r, k, t in got if r == "edges"} == keyed
    assert (inside, base, stack) == (0, 0, [])


def test_relabel_keeps_the_last_values_by_former_ids(spark):
    """long keys are left out of the joins, and the result stays."""
    n = spark.createDataFrame([("A:1", "x"), ("A:2", "y"), ("B:1", "z")], "id string, name string")
    e = spark.createDataFrame([("A:1", "p", "B:1", "one"), ("A:2", "p", "B:1", "two"), ("A:2", None, "B:1", None)], "subject string, predicate string, object string, note string")
    m = spark.createDataFrame([("A:1", "C:1"), ("A:2", "C:1")], "old string, new string")
    g = store.relabel(KG(n, e), m)
    got = {(r.subject, r.predicate, r.object, r.edge_key, r.note) for r in g.edges.collect()}
    assert got == {("C:1", "p", "B:1", "C:1-p-B:1", "two"), ("C:1", None, "B:1", "C:1-B:1", None)}
    assert {(r.subject, r.predicate) for r in store.relabel(KG(n, e.drop("note")), m).edges.collect()} == {("C:1", "p"), ("C:1", None)}
    plan = store.relabel(KG(n, e.drop("note")), m).edges._jdf.queryExecution().optimizedPlan().toString()
    assert "_seq" not in plan


def test_edges_are_looked_up_once_for_a_document(spark, monkeypatch):
    """one grouping of the edges gives all counts of a document."""
    calls, real = [], summary.grouped
    monkeypatch.setattr(summary, "grouped", lambda *a: calls.append(a) or real(*a))
    g = chain(spark, 5).with_(edges=chain(spark, 5).edges.withColumn("aks", F.lit("a|b")).withColumn("relation", F.lit("r")))
    s = summary.graph_summary(g, (), ("aks",))
    t = f"{NS}:Gene-{NS}:related_to-{NS}:Gene"
    assert s["edge_stats"]["count_by_spo"] == {t: {"count": 4, "aks": {"a": {"count": 4}, "b": {"count": 4}}}} and s["edge_stats"]["total_edges"] == 4
    assert len(calls) == 1
    m = summary.MetaGraph(g, "provided_by", "aks").document()
    assert m["edges"] == [{"subject": f"{NS}:Gene", "predicate": f"{NS}:related_to", "object": f"{NS}:Gene", "relations": ["r"], "count": 4, "count_by_source": {"aks": {"a": 4, "b": 4}}}]
    assert len(calls) == 2


def test_edges_of_a_hub_are_not_sent_to_one_task(spark):
    """ends are made distinct before they meet the nodes."""
    plan = reshape.remove_singletons(chain(spark, 5)).nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftSemi") :]


def test_stream_batches_take_several_files(spark):
    """a batch is no longer one file, which one task reads."""
    e = chain(spark, 40).edges.withColumn("seq", F.lit(1)).repartition(7)
    seen, real = [], streams.edge_stream
    try:
        streams.edge_stream = lambda *a, **k: seen.append(k) or real(*a, **k)
        assert streams.upserted(spark, e).count() == 40
    finally:
        streams.edge_stream = real
    assert seen == [{"maxFilesPerTrigger": "3"}]


@pytest.mark.parametrize(("fmt", "mode"), [("tsv", "gz"), ("csv", "gz"), ("tsv", "bz2"), ("tsv", "")])
def test_archives_are_joined_from_parts(spark, tmp_path, fmt, mode):
    """tasks write the parts, and one task streams through the archive."""
    g = chain(spark, 50)
    g = g.with_(nodes=g.nodes.withColumn("name", F.concat(F.lit("é "), "id")))
    path = files.write_archive(spark, g, str(tmp_path / f"x.tar{'.' * bool(mode)}{mode}"), fmt, mode)
    with tarfile.open(path) as tar:
        text = tar.extractfile(f"x_nodes.{fmt}").read().decode()
        assert tar.getnames() == [f"x_nodes.{fmt}", f"x_edges.{fmt}"] and text.count("\n") == 51 and text.count("category") == 1
    back = delimited.load(spark, path, fmt, f"tar.{mode}" if mode else "tar")
    assert sorted((r.id, r.name) for r in back.nodes.collect()) == sorted((r.id, r.name) for r in g.nodes.collect())
    assert back.edges.count() == 50


def test_constants_are_not_searched_from_the_start(spark):
    """prefixes are found by a checksum, with the results of a plain map."""
    px = {f"P{i}": f"http://example.org/{i}/" for i in range(200)} | {"É": "http://example.org/é/"}
    ids = [*(f"P{i}:{i}" for i in range(0, 210, 7)), "É:1", "no curie", None, ":1"]
    d = spark.createDataFrame([(x,) for x in ids], "id string").select("id", curie.expand("id", px).alias("iri"))
    want = {x: px[x.partition(":")[0]] + x.partition(":")[2] if x and x.partition(":")[0] in px and ":" in x else x for x in ids}
    rows = d.select("id", "iri", curie.contract("iri", px).alias("back")).collect()
    assert {r.id: r.iri for r in rows} == want and all(r.back == r.id for r in rows)


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gated_edges_are_narrow_and_few(spark, tmp_path):
    """ids are made after the gate, ends of foreign prefixes go before it, and a gated
    graph has no missing ends to look for."""
    g = chain(spark, 20)
    foreign = g.edges.withColumn("object", F.concat(F.lit("Y:"), "object"))
    paths = files.write_jsonl(g.with_(edges=g.edges.unionByName(foreign)), str(tmp_path / "g"))
    load = lambda f: jsons.load_jsonl(spark, list(paths), ReadOptions(delimiter=None, filters=f))
    got = load(Filters.of({"category": {f"{NS}:Gene"}}))
    plan = _optimized(got.edges)
    assert plan.index("sha2") < plan.index("LeftSemi") and plan.count("LeftSemi") == 4 and "pmod" in plan
    every = {(r.subject, r.object): (r.id, r.edge_key) for r in load(None).edges.collect()}
    assert {(r.subject, r.object): (r.id, r.edge_key) for r in got.edges.collect()} == {k: v for k, v in every.items() if k[1] != "X:20" and k[1][0] == "X"}
    one = next(iter(every.values()))
    assert [r.edge_key for r in load(Filters.of(edges={"id": one[0]})).edges.collect()] == [one[1]]
    source = {"format": "jsonl", "filename": list(paths), "node_filters": {"category": [f"{NS}:Gene"]}}
    out = transformer.transform(spark, source)
    assert "LeftAnti" not in _optimized(out.nodes) and out.nodes.count() == 20
    assert "edge_key" not in _optimized(store.with_endpoints(store.upsert(load(None)), load(None)).nodes)


def test_lists_are_found_in_the_lines_that_hold_them(spark, tmp_path):
    """only lines with the delimiter are parsed to find undeclared lists."""
    (tmp_path / "g_nodes.tsv").write_text("id\tname\tnote\nX:1\ta\tp\nX:2\tb\tq|r\n\ts|t\tu\n")
    (tmp_path / "g_edges.tsv").write_text("subject\tpredicate\tobject\twhy\nX:1\tp\tX:2\tz\nX:1\tp\t\ta|b\n")
    paths = [str(tmp_path / f"g_{x}.tsv") for x in ("nodes", "edges")]
    table = delimited.read_table(spark, paths[0], "tsv")
    assert delimited.lines_with(spark, paths[0], table, "|").count() == 2
    g = delimited.load(spark, paths)
    assert {r.id: (r.name, r.note) for r in g.nodes.collect()} == {"X:1": ("a", ["p"]), "X:2": ("b", ["q", "r"])}  # a record without an id decides nothing
    assert [(r.subject, r.why) for r in g.edges.collect()] == [("X:1", "z")]


@pytest.mark.parametrize("preserve", [True, False])
def test_sources_are_merged_with_their_upserts(spark, preserve):
    """one grouping of all records gives the merge of the upserts."""
    one = KG(spark.createDataFrame([("A:1", "x", 1, None), ("A:1", "y", 2, ["s"]), ("A:2", None, 3, ["t"])], "id string, name string, seq long, synonym array<string>"),
             spark.createDataFrame([("A:1", "p", "A:2", "old", 1), ("A:1", "p", "A:2", "new", 2)], "subject string, predicate string, object string, note string, seq long"), "one", ("edge_key",))
    two = KG(spark.createDataFrame([("A:1", "z", 1, ["u", "s"]), ("A:3", "w", 2, None)], "id string, name string, seq long, synonym array<string>"),
             spark.createDataFrame([("A:1", "p", "A:2", "far", 1, "k"), ("A:3", "p", "A:2", None, 2, "l")], "subject string, predicate string, object string, note string, seq long, own string"), "two", ("edge_key",))
    want, got = merge.merge_all([store.upsert(one), store.upsert(two)], preserve), merge.merge_unfolded([one, two], preserve)
    for a, b in ((want.nodes, got.nodes), (want.edges, got.edges)):
        assert a.schema.simpleString() == b.select(a.columns).schema.simpleString()
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert got.name == "two" and [r.note for r in got.edges.filter("subject = 'A:1'").collect()] == [["far", "new"] if preserve else "new"]


def test_consolidated_edges_are_grouped_by_short_keys(spark):
    """the long key of an edge follows from its ends and is not grouped by."""
    g = chain(spark, 4)
    same = g.edges.limit(1).withColumn("predicate", F.lit(clique.SAME))
    out = clique.clique_merge(g.with_(edges=g.edges.unionByName(same)))
    plan = _optimized(out.edges.select("subject", "predicate", "object"))
    assert "concat_ws" not in plan and "max(" not in plan
    assert {r.edge_key for r in out.edges.collect()} == {f"X:{a}-{NS}:related_to-X:{b}" for a, b in ((0, 0), (0, 2), (2, 3), (3, 4))}


def test_compressed_lines_are_in_several_files(spark, tmp_path):
    """compressed JSON Lines, of a bounded number of records a file."""
    g = chain(spark, 50)
    paths = files.write_jsonl(g, str(tmp_path / "g"), "gzip", rows_a_file=5)
    found = [f for f in os.listdir(paths[1]) if f.endswith(".json.gz")]
    assert len(found) >= 10 and jsons.load_jsonl(spark, list(paths)).edges.count() == 50


OWL = """<?xml version="1.0"?>
<!DOCTYPE rdf:RDF [<!ENTITY o "http://purl.obolibrary.org/obo/"><!ENTITY all "<owl:Class rdf:about='&o;X_9'><rdfs:label>nine</rdfs:label></owl:Class>">]>
<!-- <rdf:RDF> --><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs='http://www.w3.org/2000/01/rdf-schema#' xmlns:owl="http://www.w3.org/2002/07/owl#">&all;
<!----><!-- > - </owl:Class> --><owl:Ontology rdf:about="http://e.org/c.owl"/>
%s
<owl:Class rdf:about="&o;X_8"><rdfs:comment><![CDATA[</owl:Class><!-- ]] > ]]]]>é --&gt; ]]&gt; ?&gt; "it's" /></rdfs:comment></owl:Class>
<?x <owl:Class> ?><owl:Class rdf:about = "a/>b" ></owl:Class ></rdf:RDF>
<!-- end </rdf:RDF> -->
"""
CLASS = """<owl:Class rdf:about="&o;X_%d"><rdfs:label xml:lang='e"n'>c &lt;%d</rdfs:label><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="&o;BFO_0000050"/>
<owl:someValuesFrom><owl:Class><owl:onProperty rdf:nodeID="n"/></owl:Class></owl:someValuesFrom></owl:Restriction></rdfs:subClassOf></owl:Class><!-- %d -->"""


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 333, 1 << 20])
def test_xml_documents_in_pieces(tmp_path, block):
    """the triples of one document, wherever blocks of it end."""
    path = tmp_path / "d.owl"
    path.write_text(OWL % "\n".join(CLASS % (i, i, i) for i in range(9)), encoding="utf-8")
    top, size = elements.head(str(path)), path.stat().st_size
    shapes = [json.loads(json.dumps(elements.shape(str(path), at, block))) for at in range(len(top), size, block)]
    starts = elements.bounds(shapes, len(top), block)
    assert len(starts) == (1 if block > size else len({(path.read_bytes().index(b"<", s) - len(top)) // block for s in starts}))
    got = []
    for a, b in zip(starts, [*starts[1:], None]):
        got += [r for t in rdf._parse(elements.children(str(path), top, a, b), str(a)) for r in t.to_pylist()]
    depth, want = 0, []
    for event, e in ET.iterparse(path, events=("start", "end")):
        depth += 1 if event == "start" else -1
        if event == "end" and depth == 1:
            want.append(e)
    want = [r for t in rdf._parse(want, "") for r in t.to_pylist()]
    plain = lambda rows: [{k: "_" if str(v).startswith("_:") and v != "_:n" else v for k, v in r.items()} for r in rows]
    assert plain(got) == plain(want) and len(got) == 1 + 9 * 8 + 2 + 3 + 1 - 1
    blank = [r["s"] for r in got if r["p"].endswith("type") and r["s"].startswith("_:")]
    assert len(set(blank)) == len(blank) == 18


def test_xml_documents_that_are_not_cut(spark, tmp_path):
    """those of another encoding, or with nothing in them, are parsed whole; a
    document that ends too early is an error."""
    text = OWL.replace('"1.0"', '"1.0" encoding="utf-16"') % ""
    for name, data in (("a.owl", text.encode("utf-16")), ("b.owl", b"<x/>"), ("c.owl", b"no")):
        (tmp_path / name).write_bytes(data)
        assert elements.head(str(tmp_path / name)) is None
    assert rdf.read_rdfxml(spark, str(tmp_path / "a.owl")).count() == 6 and rdf.read_rdfxml(spark, str(tmp_path / "b.owl")).count() == 0
    (tmp_path / "d.owl").write_text((OWL % CLASS % (1, 1, 1))[:-60])
    with pytest.raises(ValueError, match="ends within"):
        rdf.read_rdfxml(spark, str(tmp_path / "d.owl"))


def test_lines_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """one file, in order, that no single task writes; and its triples are parsed once."""
    got = files.write_lines(spark, str(tmp_path / "x.txt"), ["a", "é"], spark.range(0, 90, 1, 3).select(F.col("id").cast("string").alias("value")), ["z"])
    assert open(got, encoding="utf-8").read().split("\n") == ["a", "é", *map(str, range(90)), "z", ""]
    assert os.listdir(tmp_path) == ["x.txt"] or ".x.txt.crc" in os.listdir(tmp_path)
    (tmp_path / "d.owl").write_text(OWL % "\n".join(CLASS % (i, i, i) for i in range(50)))
    monkeypatch.setattr(elements, "BLOCK", 1000)
    t = rdf.closure_of(spark, str(tmp_path / "d.owl"))
    assert t.count() == 6 + 50 * 8 and "MapInArrow" not in _optimized(t)
    assert len(elements.pieces(spark, str(tmp_path / "d.owl"))[1]) > 5


def test_distinct_rows_are_divided_first(spark):
    """no task compares all rows that it read before they are divided; the parts grow
    in number with the rows, and the rows stay."""
    d = spark.range(0, 60, 1, 2).select((F.col("id") % 40).cast("string").alias("a"), F.when(F.col("id") % 40 > 3, "x").alias("b`c"))
    few, many = normalize.distinct_rows(d, 60), normalize.distinct_rows(d, 60, most=5)
    for got in (few, many):
        assert sorted(map(str, got.collect())) == sorted(map(str, d.distinct().collect()))
        assert "RepartitionByExpression" in _optimized(got).split("Aggregate")[1]
    assert many.rdd.getNumPartitions() == 12 and few.rdd.getNumPartitions() == 4
    g = chain(spark, 6).with_(nodes=chain(spark, 6).nodes.withColumn("provided_by", F.lit("p")), edges=chain(spark, 6).edges.withColumn("aks", F.lit("k")))
    plan = _optimized(format_queries.rows(g, n_edges=6))
    assert "RepartitionByExpression" in plan and sorted(map(str, format_queries.rows(g, n_edges=6).collect())) == sorted(map(str, format_queries.rows(g).collect()))


def test_ends_of_documents_are_looked_up_without_sorting(spark):
    """vertices are tables in memory, and keys are made without regular expressions."""
    g = chain(spark, 5)
    g = g.with_(nodes=g.nodes.unionByName(g.nodes.limit(1).withColumn("id", F.lit("X:a/b"))))
    v, e = db.arango_documents(g)
    v = v.withColumn("_id", F.concat_ws("/", "_collection", "_key")).drop("_collection")
    back = databases.load_arango(v, e.drop("_collection"))
    plan = _optimized(back.edges)
    assert plan.count("shuffle_hash") == 2 and "regexp_replace" not in plan
    assert sorted((r.subject, r.object) for r in back.edges.collect()) == [(f"X:{i}", f"X:{i + 1}") for i in range(4)]
    assert {"X:a/b"} < {r.id for r in back.nodes.collect()} and "C:1" == databases.load_arango(spark.sql("select 'C/1' _id, 'n' name"), e.drop("_collection")).nodes.first().id
