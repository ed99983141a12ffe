"""Readers and writers on small files."""

import json
import sqlite3
import tarfile

import pytest

from sparkloom.functions.catalog import NS
from sparkloom.kg import KG
from sparkloom.operators.filters import Filters
from sparkloom.plans import transformer
from sparkloom.sinks import databases as db
from sparkloom.sinks import files
from sparkloom.sources import databases, delimited, jsons, rdf, sssom
from sparkloom.sources.common import ReadOptions

NODES = f"id\tcategory\tname\tsynonym\ttaxon\nX:1\t{NS}:Gene|{NS}:NamedThing\tone\tb|a|a\t9606\nX:2\t{NS}:Disease\ttwo\t\t\n\t{NS}:Gene\tno id\t\t\nX:3\t\tthree\tc\t\n"
EDGES = f"subject\tpredicate\tobject\tpublications\tnegated\nX:1\t{NS}:related_to\tX:2\tP:2|P:1\tFalse\nX:2\t{NS}:part_of\tX:3\t\t\nX:2\t\tX:3\t\t\n"


@pytest.fixture
def tsv(tmp_path):
    (tmp_path / "g_nodes.tsv").write_text(NODES)
    (tmp_path / "g_edges.tsv").write_text(EDGES)
    return [str(tmp_path / "g_nodes.tsv"), str(tmp_path / "g_edges.tsv")]


def rows(df, *names):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*names).collect())


def test_tsv(spark, tsv):
    g = delimited.load(spark, tsv)
    assert rows(g.nodes, "id", "name", "synonym") == [("X:1", "one", ("a", "b")), ("X:2", "two", None), ("X:3", "three", ("c",))]
    assert rows(g.nodes.filter("id = 'X:1'"), "category") == [((f"{NS}:Gene", f"{NS}:NamedThing"),)]
    assert g.nodes.filter("id = 'X:3'").first().category == [f"{NS}:NamedThing"]
    assert rows(g.edges, "subject", "predicate", "object", "edge_key") == [("X:1", f"{NS}:related_to", "X:2", f"X:1-{NS}:related_to-X:2"), ("X:2", f"{NS}:part_of", "X:3", f"X:2-{NS}:part_of-X:3")]
    first = g.edges.filter("subject = 'X:1'").first()
    assert first.publications == ["P:1", "P:2"] and first.negated is True and first.id.startswith("urn:uuid:")


def test_tsv_of_a_missing_role_and_filters(spark, tsv):
    g = delimited.load(spark, tsv[:1])
    assert g.edges.count() == 0 and g.nodes.count() == 3
    o = ReadOptions(filters=Filters.of({"category": {f"{NS}:Gene"}}))
    g = delimited.load(spark, tsv, o=o)
    assert rows(g.nodes, "id") == [("X:1",)] and g.edges.count() == 0


def test_archive_round_trip(spark, tsv, tmp_path):
    g = delimited.load(spark, tsv)
    path = files.write_archive(spark, g, str(tmp_path / "out.tar.gz"))
    with tarfile.open(path) as tar:
        assert len(tar.getnames()) == 2
    back = delimited.load(spark, path, "tsv", "tar.gz")
    assert rows(back.nodes, "id", "name", "synonym") == rows(g.nodes, "id", "name", "synonym")
    assert rows(back.edges, "subject", "predicate", "object") == rows(g.edges, "subject", "predicate", "object")


def test_csv_quoting(spark, tmp_path):
    (tmp_path / "a_nodes.csv").write_text(f'id,category,name\nX:1,{NS}:Gene,"one, ""two""\nlines"\n')
    g = delimited.load(spark, str(tmp_path / "a_nodes.csv"), "csv")
    assert g.nodes.first().name == 'one, "two" lines'


def test_json_and_json_lines(spark, tsv, tmp_path):
    g = delimited.load(spark, tsv)
    files.write_json(spark, g, str(tmp_path / "g.json"))
    doc = json.loads((tmp_path / "g.json").read_text())
    assert len(doc["nodes"]) == 3 and len(doc["edges"]) == 2
    a = jsons.load_json(spark, str(tmp_path / "g.json"))
    b = jsons.load_jsonl(spark, list(files.write_jsonl(g, str(tmp_path / "l"))))
    for back in (a, b):
        assert rows(back.nodes, "id", "name", "synonym", "category") == rows(g.nodes, "id", "name", "synonym", "category")
        assert rows(back.edges, "subject", "predicate", "object", "publications") == rows(g.edges, "subject", "predicate", "object", "publications")


def test_parquet_and_databases(spark, tsv, tmp_path):
    import duckdb

    g = delimited.load(spark, tsv)
    n, e = files.write_parquet(g, str(tmp_path / "p"))
    assert rows(databases.load_parquet(spark, n, e).nodes, "id", "name") == rows(g.nodes, "id", "name")
    db.write_sqlite(g, str(tmp_path / "g.db"))
    con = sqlite3.connect(tmp_path / "g.db")
    assert con.execute("select count(*) from nodes").fetchone() == (3,) and con.execute("select object from edges where subject = 'X:1'").fetchall() == [("X:2",)]
    with duckdb.connect(str(tmp_path / "g.duckdb")) as con:
        con.execute(f"create table nodes as select * from '{n}/*.parquet'")
        con.execute(f"create table edges as select * from '{e}/*.parquet'")
    back = databases.load_duckdb(spark, str(tmp_path / "g.duckdb"), page=2)
    assert rows(back.nodes, "id", "name") == rows(g.nodes, "id", "name") and back.edges.count() == 2
    v, w = db.arango_documents(g)
    assert rows(v, "_collection", "_key") == [("X", "1"), ("X", "2"), ("X", "3")]
    assert rows(w, "_from", "_to") == [("X/1", "X/2"), ("X/2", "X/3")]


def test_ntriples(spark, tmp_path):
    lines = [
        "<http://purl.obolibrary.org/obo/HP_1> <http://www.w3.org/2000/01/rdf-schema#label> \"a \\\"b\\\" \\u00e9\"@en .",
        f"<http://purl.obolibrary.org/obo/HP_1> <https://w3id.org/{NS}/vocab/category> <https://w3id.org/{NS}/vocab/PhenotypicFeature> .",
        "<http://purl.obolibrary.org/obo/HP_1> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://purl.obolibrary.org/obo/HP_2> .",
        "# a comment", "", "broken line",
    ]
    (tmp_path / "a.nt").write_text("\n".join(lines))
    g = rdf.load_ntriples(spark, str(tmp_path / "a.nt"))
    n = {r.id: r for r in g.nodes.collect()}
    assert set(n) == {"HP:1", "HP:2"} and n["HP:1"].name == 'a "b" é'
    assert rows(g.edges, "subject", "predicate", "object") == [("HP:1", f"{NS}:subclass_of", "HP:2")]
    with pytest.raises(Exception, match="malformed"):
        rdf.read_ntriples(spark, str(tmp_path / "a.nt"), strict=True).collect()


def test_ntriples_literals(spark, tmp_path):
    """No literal is lost: escapes of all kinds, wrong ones, comments with quotes, long texts."""
    long = "word \\\\ " * 60_000
    cases = [
        (r'"face \U0001F600 end"', "face \U0001F600 end"), (r'"a\\Ub \u00e9"', "a\\Ub é"), (r'"it\'s"', "it's"), (r'"bad \q here"', r"bad \q here"), (r'"C:\\temp\tx"', "C:\\temp\tx"),
        (r'"x"@en # says "hi" there', "x"), ('"' + long + '"', long.replace("\\\\", "\\")), (r'"7"^^<http://www.w3.org/2001/XMLSchema#integer>', "7"), ('""', ""),
    ]
    (tmp_path / "l.nt").write_text("".join(f"<http://e.org/{i}> <http://e.org/p> {x.replace('@en #', '@en . #')}{'' if '#' in x and 'says' in x else ' .'}\n" for i, (x, _) in enumerate(cases)))
    got = {int(r.s.rsplit("/", 1)[1]): r for r in rdf.read_ntriples(spark, str(tmp_path / "l.nt")).collect()}
    assert {i: r.o for i, r in got.items()} == {i: v for i, (_, v) in enumerate(cases)}
    assert got[5].lang == "en" and got[7].datatype.endswith("integer") and got[0].lang is None


def test_owl_imports(spark, tmp_path):
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    sub = lambda a, b: f'<owl:Class rdf:about="http://purl.obolibrary.org/obo/HP_{a}"><rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/HP_{b}"/></owl:Class>'
    imp = lambda *x: '<owl:Ontology rdf:about="http://e.org/o">' + "".join(f'<owl:imports rdf:resource="{i}"/>' for i in x) + "</owl:Ontology>"
    (tmp_path / "a.owl").write_text(head + imp("http://e.org/b.owl", "http://e.org/absent.owl") + sub(1, 2) + "</rdf:RDF>")
    (tmp_path / "b.owl").write_text(head + imp("http://e.org/far") + sub(2, 3) + "</rdf:RDF>")
    (tmp_path / "c.owl").write_text(head + imp("http://e.org/b.owl") + sub(3, 4) + "</rdf:RDF>")
    g = rdf.load_owl(spark, str(tmp_path / "a.owl"), also={"http://e.org/far": str(tmp_path / "c.owl")})
    assert [("HP:1", "HP:2"), ("HP:2", "HP:3"), ("HP:3", "HP:4")] == rows(g.edges.filter("relation = 'rdfs:subClassOf'"), "subject", "object")


def test_edges_of_a_graph_database_keep_their_properties(spark):
    r = spark.sql("select named_struct('id', 'A:1') s, named_struct('predicate', 'x:p', 'relation', 'r', 'score', 0.5D, 'subject', 'old') p, named_struct('id', 'B:1') o")
    e = databases.with_ends(r)
    assert set(e.columns) == {"subject", "object", "predicate", "relation", "score"} and e.first().asDict() == {"subject": "A:1", "object": "B:1", "predicate": "x:p", "relation": "r", "score": 0.5}


def test_bounds_of_single_writers(spark, tsv, tmp_path):
    g = delimited.load(spark, tsv)
    with pytest.raises(ValueError, match="too many"):
        db.write_sqlite(g, str(tmp_path / "x.sqlite"), most=1)
    with pytest.raises(ValueError, match="too large"):
        files.write_archive(spark, g, str(tmp_path / "x.tar.gz"), most=3)


def test_owl(spark, tmp_path):
    (tmp_path / "a.owl").write_text(
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
        '<owl:Class rdf:about="http://purl.obolibrary.org/obo/HP_1"><rdfs:label>one</rdfs:label><rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/HP_2"/>'
        '<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://purl.obolibrary.org/obo/BFO_0000050"/><owl:someValuesFrom rdf:resource="http://purl.obolibrary.org/obo/HP_3"/></owl:Restriction></rdfs:subClassOf></owl:Class></rdf:RDF>'
    )
    g = rdf.load_owl(spark, str(tmp_path / "a.owl"))
    assert ("HP:1", "HP:2") in rows(g.edges, "subject", "object") and ("HP:1", "HP:3") in rows(g.edges, "subject", "object")


def test_obograph(spark, tmp_path):
    doc = {"graphs": [{"nodes": [{"id": "http://purl.obolibrary.org/obo/HP_1", "lbl": "one", "type": "CLASS", "meta": {"definition": {"val": "first"}, "synonyms": [{"pred": "hasExactSynonym", "val": "uno"}]}}, {"id": "http://purl.obolibrary.org/obo/HP_2", "type": "CLASS"}], "edges": [{"sub": "http://purl.obolibrary.org/obo/HP_1", "pred": "is_a", "obj": "http://purl.obolibrary.org/obo/HP_2"}]}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    g = jsons.load_obograph(spark, str(tmp_path / "o.json"))
    one = g.nodes.filter("id = 'HP:1'").first()
    assert one.name == "one" and one.description == "first"
    assert rows(g.edges, "subject", "predicate", "object") == [("HP:1", f"{NS}:subclass_of", "HP:2")]


def test_trapi_round_trip(spark, tsv, tmp_path):
    g = delimited.load(spark, tsv)
    files.write_trapi(spark, g, str(tmp_path / "t.json"), "infores:me")
    doc = json.loads((tmp_path / "t.json").read_text())["knowledge_graph"]
    assert set(doc["nodes"]) == {"X:1", "X:2", "X:3"} and doc["nodes"]["X:1"]["name"] == "one"
    assert {(e["subject"], e["object"]) for e in doc["edges"].values()} == {("X:1", "X:2"), ("X:2", "X:3")}
    back = jsons.load_trapi(spark, str(tmp_path / "t.json"))
    assert rows(back.edges, "subject", "predicate", "object") == rows(g.edges, "subject", "predicate", "object")
    assert rows(back.nodes, "id", "name") == rows(g.nodes, "id", "name")


def test_mapping_set(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("#mapping_provider: someone\nsubject_id\tsubject_label\tpredicate_id\tobject_id\tconfidence\nA:1\tone\tskos:exactMatch\tB:1\t0.9\n")
    g = sssom.load(spark, str(tmp_path / "m.tsv"))
    e = g.edges.first()
    assert (e.subject, e.predicate, e.object, e.confidence, e.knowledge_source) == ("A:1", f"{NS}:exact_match", "B:1", "0.9", "someone")
    assert rows(g.nodes, "id") == [("A:1",), ("B:1",)]


def test_transform_and_merge_by_description(spark, tsv, tmp_path):
    out = str(tmp_path / "out")
    transformer.transform(spark, {"format": "tsv", "filename": tsv}, {"format": "jsonl", "filename": out}, [{"name": "remove_singleton_nodes"}])
    assert spark.read.json(f"{out}_nodes.jsonl").count() == 3
    kg = transformer.run_merge(spark, {"merged_graph": {"name": "m", "source": {k: {"input": {"format": "tsv", "filename": tsv}} for k in ("a", "b")}, "destination": {"d": {"format": "json", "filename": str(tmp_path / "m.json")}}}})
    assert kg.nodes.count() == 3 and kg.edges.count() == 2 and (tmp_path / "m.json").exists()
    with pytest.raises(ValueError):
        transformer.load(spark, {"format": "nothing"})


def test_command_line(spark, tsv, tmp_path, capsys):
    from sparkloom import cli

    assert cli.main(["graph-summary", *tsv, "-o", str(tmp_path / "s.json"), "-f", "json"]) == 0
    s = json.loads((tmp_path / "s.json").read_text())
    assert s["node_stats"]["total_nodes"] == 3 and s["edge_stats"]["total_edges"] == 2
    assert cli.main(["transform", *tsv, "-f", "jsonl", "-o", str(tmp_path / "c")]) == 0
    assert cli.main(["validate", *tsv, "-o", str(tmp_path / "v.json")]) == 1
    assert "MISSING_EDGE_PROPERTY" in json.loads((tmp_path / "v.json").read_text())["ERROR"]


def test_statements():
    assert "MATCH" in databases.cypher_nodes({"category": {f"{NS}:Gene"}}, 0, 10)
    assert db.cypher_constraint(f"{NS}:Gene").endswith("REQUIRE n.id IS UNIQUE")
    assert isinstance(KG, type)
