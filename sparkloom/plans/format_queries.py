"""Queries that write the whole graph in a format, or make a source in it, and read that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import NS
from ..kg import KG
from ..operators.filters import Filters
from ..operators.normalize import distinct_rows
from ..sinks import databases as db
from ..sinks import files
from ..sources import databases, jsons, rdf, sssom
from . import roundtrips, transformer
from .registry import flat, query
from .views import EDGES_SQL, NODES_SQL, graph, nodes, read

PACKED = {"compression": "gzip", "rows_a_file": 1_000_000}  # of JSON Lines
OBO = "http://purl.obolibrary.org/obo/"
TRIP = "{W} select 'node' as kind, id as a, coalesce(name, '') as b, category as c, provided_by as d from n union all (select distinct 'edge', subject, predicate, object, aks from e)"


def rows(kg: KG, upserted: bool = False, n_edges: int | None = None) -> DataFrame:
    """Nodes and distinct edges in one table of strings. Those of an upserted graph are
    distinct by their ends and predicate. ``n_edges`` is their number where it is known."""
    text = lambda df, c: F.concat_ws("|", c) if df.schema[c].dataType.typeName() == "array" else F.col(c)
    n, e = kg.nodes, kg.edges
    one = n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.coalesce("name", F.lit("")).alias("b"), text(n, "category").alias("c"), text(n, "provided_by").alias("d"))
    two = e.select(F.col("subject").alias("a"), F.col("predicate").alias("b"), F.col("object").alias("c"), text(e, "aks").alias("d"))
    two = two if upserted else two.distinct() if n_edges is None else distinct_rows(two, n_edges)
    return one.unionByName(two.withColumn("kind", F.lit("edge")))


def plain(spark, d) -> KG:
    g = graph(spark, d)
    return g.with_(edges=g.edges.select("subject", "predicate", "object", "aks"))


@query(TRIP)
def tsv_roundtrip(spark, d):
    return rows(roundtrips.tsv(spark, graph(spark, d)))


@query(TRIP)
def jsonl_roundtrip(spark, d):
    return rows(roundtrips.jsonl(spark, graph(spark, d)))


@query(TRIP)
def json_roundtrip(spark, d):
    return rows(jsons.load_json(spark, files.write_json(spark, plain(spark, d), roundtrips._base(spark) + ".json")))


@query(TRIP)
def parquet_roundtrip(spark, d):
    g = databases.load_parquet(spark, *files.write_parquet(plain(spark, d), roundtrips._base(spark)))
    return rows(g, n_edges=g.edges.count())  # footers have that


@query(TRIP)
def trapi_roundtrip(spark, d):
    return rows(jsons.load_trapi(spark, files.write_trapi(spark, plain(spark, d), roundtrips._base(spark) + ".json")))  # it holds an edge once


@query(TRIP)
def trapi_lines_roundtrip(spark, d):
    return rows(jsons.load_trapi(spark, files.write_trapi(spark, plain(spark, d), roundtrips._base(spark) + ".jsonl", compression="gzip")))


@query(TRIP)
def archive_roundtrip(spark, d):
    """A tar archive is one file of the driver's file system, which tasks read whole."""
    from ..sources import delimited

    base = roundtrips._base(spark)
    fs, p = files._fs(spark, base)
    fs.mkdirs(p)
    path = files.write_archive(spark, plain(spark, d), base.removeprefix("file://").removeprefix("file:") + "/x.tar.gz", "tsv", "gz", base + "/x")
    return rows(delimited.load(spark, path, "tsv", "tar.gz"))


@query(TRIP)
def arango_roundtrip(spark, d):
    g = plain(spark, d)
    v, e = db.arango_documents(g)
    v = v.withColumn("_id", F.concat_ws("/", "_collection", "_key")).drop("_collection")
    return rows(databases.load_arango(v, e.drop("_collection")), n_edges=g.edges.count())


@query("{W} select distinct subject, predicate, object from e")
def nt_roundtrip(spark, d):
    g = graph(spark, d)
    return roundtrips.ntriples(spark, g.with_(edges=g.edges.select("subject", "predicate", "object"))).edges.select("subject", "predicate", "object")


@query(TRIP)
def nt_properties_roundtrip(spark, d):
    """Edges with a property are reified; nodes bring name, category and provider."""
    g = roundtrips.ntriples(spark, plain(spark, d))
    n = g.nodes.withColumn("category", F.filter("category", lambda c: c != f"{NS}:NamedThing"))
    return rows(g.with_(nodes=n))


@query("select doc_id, text from documents where text is not null")
def nt_literals(spark, d):
    """Whole texts as literals of N-Triples."""
    t = read(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("DOC:"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("description"))
    path = roundtrips._base(spark) + ".nt"
    files.ntriples(KG(t, graph(spark, d).edges.limit(0))).write.text(path)
    got = rdf.read_ntriples(spark, path).filter(F.col("literal") & F.col("p").endswith("description"))
    return got.select(F.element_at(F.split("s", "[^0-9]"), -1).cast("long").alias("doc_id"), F.col("o").alias("text"))


@query("select 'HP:' || c_custkey as id, c_mktsegment as market, 'HP:' || c_nationkey as home from customer")
def nt_named_properties(spark, d):
    """Predicates that the caller names, and ones whose objects are properties, not ends."""
    c = read(spark, d, "customer")
    s = lambda k: F.concat(F.lit(f"<{OBO}HP_"), F.col(k).cast("string"), F.lit(">"))
    line = lambda p, o: F.concat_ws(" ", s("c_custkey"), F.lit(f"<http://example.org/p/{p}>"), o, F.lit("."))
    path = roundtrips._base(spark) + ".nt"
    c.select(F.explode(F.array(line("segment", F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))), line("home", s("c_nationkey")))).alias("value")).write.text(path)
    g = rdf.load_ntriples(spark, path, names={"http://example.org/p/segment": "market", "http://example.org/p/home": "home"}, node_properties=("home",))
    return g.nodes.select("id", "market", "home")


def _folder(spark) -> str:
    """A new folder of the shared ones, as a path of the file system."""
    base = roundtrips._base(spark)
    fs, p = files._fs(spark, base)
    fs.mkdirs(p)
    return base.removeprefix("file://").removeprefix("file:")


def _duckdb(spark, d) -> str:
    """The graph as a folder of DuckDB files that all tasks of this host can open."""
    g = graph(spark, d)
    return db.write_duckdb(g.with_(edges=g.edges.drop("quantity")), _folder(spark), edge_order=("subject", "predicate", "object", "seq"))


@query(TRIP)
def duckdb_source(spark, d):
    return rows(databases.load_duckdb(spark, _duckdb(spark, d)))


@query(
    "{W}, k as (select id from n where category = '{B}:Agent') select 'node' as kind, id as a, coalesce(name, '') as b, category as c, provided_by as d from n where id in (from k) "
    "union all (select distinct 'edge', subject, predicate, object, aks from e where subject in (from k) and object in (from k))"
)
def duckdb_filters(spark, d):
    """Filters that run in the database, and gate the edges."""
    return rows(databases.load_duckdb(spark, _duckdb(spark, d), Filters.of(nodes={"category": {f"{NS}:Agent"}})))


@query(
    "{W}, r as (select 'node' as kind, id as a, coalesce(name, '') as b, category as c, provided_by as d, row_number() over (order by id) - 1 as k from n union all "
    "select 'edge', subject, predicate, object, aks, (select count(*) from n) + row_number() over (order by subject, predicate, object, seq) - 1 from e) "
    "select distinct kind, a, b, c, d from r where k >= 700 and k < (select count(*) from n) + 3000"
)
def duckdb_slice(spark, d):
    """Records by row number, nodes then edges."""
    path = _duckdb(spark, d)
    return rows(databases.load_duckdb(spark, path, start=700, end=nodes(spark, d).count() + 3000))


@query(TRIP)
def sqlite_sink(spark, d):
    """The tables that the writer makes, a file a task, read back."""
    return rows(databases.load_sqlite(spark, db.write_sqlite_parts(plain(spark, d), _folder(spark))))


def _lines(spark, first: list[str], lines: DataFrame, last: list[str] = ()) -> str:
    """A text file of the given lines, in order."""
    return files.write_lines(spark, roundtrips._base(spark) + ".txt", first, lines, last)


@query(
    "select 'node' as kind, 'HP:' || c_custkey as a, c_name as b, '{B}:PhenotypicFeature' as c, c_mktsegment as d, c_mktsegment || '|seg' as f from customer union all "
    "select 'edge', 'HP:' || c_custkey, case c_custkey % 4 when 0 then '{B}:subclass_of' when 1 then '{B}:part_of' when 2 then '{B}:has_part' else '{B}:related_to' end, 'HP:' || c_nationkey, "
    "case c_custkey % 4 when 0 then 'rdfs:subClassOf' when 1 then 'BFO:0000050' when 2 then 'BFO:0000051' else 'HP:9999' end, '' from customer"
)
def obograph_source(spark, d):
    """Ontology JSON: terms with definitions and synonyms, relations by name and by IRI."""
    c = read(spark, d, "customer")
    iri = lambda k: F.concat(F.lit(OBO + "HP_"), k.cast("string"))
    meta = F.struct(F.struct(F.col("c_mktsegment").alias("val")).alias("definition"), F.array(F.struct(F.lit("hasExactSynonym").alias("pred"), F.col("c_mktsegment").alias("val")), F.struct(F.lit("hasExactSynonym").alias("pred"), F.lit("seg").alias("val"))).alias("synonyms"))
    n = c.select(F.to_json(F.struct(iri(F.col("c_custkey")).alias("id"), F.col("c_name").alias("lbl"), F.lit("CLASS").alias("type"), meta.alias("meta"))).alias("v"))
    k = F.col("c_custkey") % 4
    pred = F.when(k == 0, "is_a").when(k == 1, OBO + "BFO_0000050").when(k == 2, "has_part").otherwise(OBO + "HP_9999")
    e = c.select(F.to_json(F.struct(iri(F.col("c_custkey")).alias("sub"), pred.alias("pred"), iri(F.col("c_nationkey")).alias("obj"))).alias("v"))
    g = jsons.load_obograph(spark, files.write_document(spark, {"nodes": n, "edges": e}, roundtrips._base(spark) + ".json", '{"graphs": [{', "}]}\n"))
    out = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.concat_ws("|", "category").alias("c"), F.col("description").alias("d"), F.concat_ws("|", "synonym").alias("f"))
    return out.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("subject").alias("a"), F.col("predicate").alias("b"), F.col("object").alias("c"), F.col("relation").alias("d"), F.lit("").alias("f")))


@query(
    "select 'node' as kind, 'CUST:' || c_custkey as a, c_name as b, '{B}:OntologyClass' as c, '' as d from customer union all "
    "select 'node', 'SEG:' || c_mktsegment, c_mktsegment, '{B}:Agent', '' from customer union all "
    "select 'edge', 'CUST:' || c_custkey, case when c_custkey % 2 = 0 then '{B}:exact_match' else '{B}:related_to' end, 'SEG:' || c_mktsegment, round(c_acctbal)::bigint::varchar || '|someone' from customer"
)
def mapping_set_source(spark, d):
    """A mapping set with its commented header."""
    c = read(spark, d, "customer")
    cells = [F.concat(F.lit("CUST:"), F.col("c_custkey").cast("string")), F.col("c_name"), F.lit("term"), F.when(F.col("c_custkey") % 2 == 0, "skos:exactMatch").otherwise("skos:closestMatch"),
             F.concat(F.lit("SEG:"), F.col("c_mktsegment")), F.col("c_mktsegment"), F.lit(f"{NS}:Agent"), F.round("c_acctbal").cast("long").cast("string")]
    head = ["# curie_map:", "#   CUST: http://example.org/c/", "# mapping_provider: someone", "\t".join("subject_id subject_label subject_category predicate_id object_id object_label object_category confidence".split())]
    g = sssom.load(spark, _lines(spark, head, c.select(F.concat_ws("\t", *cells).alias("value"))))
    text = lambda x: F.concat_ws("|", x)
    n = g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), text("category").alias("c"), F.lit("").alias("d"))
    return n.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("subject").alias("a"), F.col("predicate").alias("b"), F.col("object").alias("c"), F.concat_ws("|", "confidence", "knowledge_source").alias("d")))


def _classes(t: DataFrame, key: str, prefix: str, parent: Column, label: str, some: Column | None = None) -> DataFrame:
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    about = F.concat(F.lit(f"{OBO}{prefix}_"), F.col(key).cast("string"))
    body = F.concat(F.lit('<owl:Class rdf:about="'), about, F.lit('"><rdfs:label>'), esc(F.col(label)), F.lit('</rdfs:label><rdfs:subClassOf rdf:resource="'), parent, F.lit('"/>'))
    if some is not None:
        body = F.concat(body, F.lit(f'<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="{OBO}BFO_0000050"/><owl:someValuesFrom rdf:resource="'), some, F.lit('"/></owl:Restriction></rdfs:subClassOf>'))
    return t.select(F.concat(body, F.lit("</owl:Class>")).alias("value"))


@query(
    "select distinct 'HP:' || c_custkey as subject, '{B}:subclass_of' as predicate, 'GO:' || c_nationkey as object, 'rdfs:subClassOf' as relation, '' as how from customer union "
    "select 'HP:' || c_custkey, '{B}:part_of', 'GO:' || c_nationkey, 'BFO:0000050', 'owlstar:AllSomeInterpretation' from customer union "
    "select 'GO:' || n_nationkey, '{B}:subclass_of', 'SO:' || n_regionkey, 'rdfs:subClassOf', '' from nation"
)
def ontology_source(spark, d):
    """An ontology with restrictions, and the one that it imports."""
    head = ['<?xml version="1.0"?>', '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">']
    other = "http://example.org/nations.owl"
    to = lambda p, k: F.concat(F.lit(f"{OBO}{p}_"), F.col(k).cast("string"))
    n = _lines(spark, head, _classes(read(spark, d, "nation"), "n_nationkey", "GO", to("SO", "n_regionkey"), "n_name"), last=["</rdf:RDF>"])
    start = [*head, f'<owl:Ontology rdf:about="http://example.org/c.owl"><owl:imports rdf:resource="{other}"/></owl:Ontology>']
    c = _lines(spark, start, _classes(read(spark, d, "customer"), "c_custkey", "HP", to("GO", "c_nationkey"), "c_name", to("GO", "c_nationkey")), last=["</rdf:RDF>"])
    e = rdf.load_owl(spark, c, also={other: n}).edges
    return e.filter(~F.col("relation").isin("rdf:type", "owl:imports")).select("subject", "predicate", "object", "relation", F.coalesce("logical_interpretation", F.lit("")).alias("how")).distinct()


@query(
    "{W}, s as (select id from n where category in ('{B}:Agent', '{B}:Event')) select 'node' as kind, id as a, coalesce(name, '') as b, category as c, provided_by as d from n where id in (from s) "
    "union all (select distinct 'edge', subject, predicate, object, aks from e where subject in (from s) and object in (from s))"
)
def configured_transform(spark, d):
    """A configuration: TSV in, filtered; JSON Lines out; that read again by another."""
    base = roundtrips._base(spark)
    paths = files.write_delimited(plain(spark, d), base, "tsv")
    where = {"node_filters": {"category": [f"{NS}:Agent", f"{NS}:Event"]}}
    one = {"transform": {"source": {"g": {"input": {"format": "tsv", "filename": list(paths), "filters": where}, **where, "output": {"format": "jsonl", "filename": base + "_out", **PACKED}}}}}
    one["transform"]["source"]["g"]["filters"] = where
    transformer.run_transform(spark, one)
    return rows(transformer.transform(spark, {"format": "jsonl", "filename": [f"{base}_out_nodes.jsonl", f"{base}_out_edges.jsonl"]}), upserted=True)


@query("{W} select 'node' as kind, id as a, coalesce(name, '') as b, category as c, provided_by as d from n union all (select distinct 'edge', subject, predicate, object, aks from e)")
def configured_merge(spark, d):
    """A merge configuration of two files' graphs, written as Parquet and reread."""
    g, base = plain(spark, d), roundtrips._base(spark)
    far = F.col("predicate").isin(f"{NS}:part_of", f"{NS}:located_in")
    one = files.write_jsonl(KG(g.nodes, g.edges.filter(far)), base + "_1", **PACKED)
    two = files.write_jsonl(KG(g.nodes, g.edges.filter(~far)), base + "_2", **PACKED)
    sources = {f"s{i}": {"input": {"format": "jsonl", "filename": list(x)}} for i, x in enumerate((one, two))}
    transformer.run_merge(spark, {"merged_graph": {"name": "all", "source": sources, "destination": {"out": {"format": "parquet", "filename": base + "_all"}}}})
    out = databases.load_parquet(spark, f"{base}_all_nodes.parquet", f"{base}_all_edges.parquet")
    return rows(out.with_(nodes=flat(out.nodes, "category"), edges=out.edges), upserted=True)


@query(
    "select * from (values ('cypher_nodes', 'MATCH (n) WHERE (n:`{B}:Gene`) AND (''x'' IN n.`provided_by`) RETURN n SKIP 5 LIMIT 10'), ('cypher_edges', 'MATCH (s)-[p]-(o) WHERE type(p) IN [''a'', ''b''] AND (s:`{B}:Gene`) RETURN COUNT(p) AS count'), "
    "('aql', 'FILTER LENGTH(INTERSECTION(v.`category`, [\"x\"])) > 0 AND v.`name` IN [\"a\", \"b\"]'), ('sql', 'list_has_any(\"category\", [''x'']) AND \"name\" IN (''a'', ''it''''s'')'), "
    "('constraint', 'CREATE CONSTRAINT IF NOT EXISTS FOR (n:`{B}:Gene`) REQUIRE n.id IS UNIQUE')) as t(dialect, text)"
)
def filter_texts(spark, d):
    """Filters and constraints as texts of the databases' languages."""
    from ..operators.filters import sql_where

    out = [
        ("cypher_nodes", databases.cypher_nodes({"category": {f"{NS}:Gene"}, "provided_by": "x"}, 5, 10)),
        ("cypher_edges", databases.cypher_edges({"predicate": ["b", "a"], "subject_category": {f"{NS}:Gene"}}, directed=False, count=True)),
        ("aql", databases.aql_filter({"category": "x", "name": {"a", "b"}}, "v")),
        ("sql", sql_where({"category": "x", "name": {"a", "it's"}})),
        ("constraint", db.cypher_constraint(f"{NS}:Gene")),
    ]
    return spark.createDataFrame(out, "dialect string, text string")


@query("select 'nodes' as kind, unnest(range(5))::int as pos, unnest(['id', 'category', 'name', 'provided_by', 'zeta']) as property union all select 'edges', unnest(range(6))::int, unnest(['id', 'subject', 'predicate', 'object', 'aks', '_x'])")
def column_order(spark, d):
    """Core columns first, others by name, internal ones last; unused ones are left out."""
    g = plain(spark, d)
    g = KG(g.nodes.withColumn("zeta", F.lit("z")).withColumn("alpha", F.lit(None).cast("string")), g.edges.withColumn("_x", F.lit(1)).withColumn("id", F.lit("i")))
    n, e = files.shown_properties(g)
    return spark.createDataFrame([("nodes", i, c) for i, c in enumerate(n)] + [("edges", i, c) for i, c in enumerate(e)], "kind string, pos int, property string")
