"""Further queries that exercise operators on the whole graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curie
from ..functions.catalog import NS
from ..kg import KG
from ..operators import clique, closure, filters, merge, normalize, provenance, store, summary, validate
from ..sources.common import ReadOptions, finish
from ..streaming import streams
from . import transformer
from .registry import flat, query
from .views import edges, graph, nodes, read


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


# --- filters and store ----------------------------------------------------------------


@query(
    "{W}, k as (select id from n where category in ('{B}:Agent', '{B}:GeographicLocation')) select subject, predicate, object, seq from e "
    "where subject in (from k) and object in (from k) and predicate in ('{B}:located_in', '{B}:provides')"
)
def store_filters(spark, d):
    g = transformer.operate(graph(spark, d), [{"name": "apply_filters", "args": {"node_filters": {"category": [f"{NS}:Agent", f"{NS}:GeographicLocation"]}, "edge_filters": {"predicate": [f"{NS}:located_in", f"{NS}:provides"]}}}])
    return g.edges.select("subject", "predicate", "object", "seq")


@query("{W} select id from n where category in ('{B}:Agent', '{B}:Event')")
def filter_nodes(spark, d):
    return filters.filter_nodes(graph(spark, d), {f"{NS}:Agent", f"{NS}:Event"}).nodes.select("id")


@query("{W} select subject, predicate, object, seq from e where not (predicate = '{B}:provides' and subject like 'SUPP:%' and quantity is not null and (subject, object) in (select subject, object from e where quantity < 10 and predicate = '{B}:provides'))")
def remove_edges(spark, d):
    """All edges of an end pair that has a small quantity, by key."""
    g = graph(spark, d)
    g = g.with_(edges=store.keyed(g.edges))
    gone = g.edges.filter(f"quantity < 10 and predicate = '{NS}:provides'").select("subject", "object", "edge_key")
    return store.remove_edges(g, gone).edges.select("subject", "predicate", "object", "seq")


@query(
    "{W} select 'node' as what, id as a, category as b, '' as c from n where id = 'NATION:3' union all select 'in', subject, predicate, object from e where object = 'NATION:3' "
    "union all select 'out', subject, predicate, object from e where subject = 'NATION:3' union all select 'edge', subject, predicate, object from e where subject = 'NATION:3' and object = 'REGION:' || (select n_regionkey from nation where n_nationkey = 3)"
)
def lookups(spark, d):
    g = graph(spark, d)
    region = store.out_edges(g, "NATION:3").select("object").first()[0]
    e = lambda what, df: df.select(F.lit(what).alias("what"), F.col("subject").alias("a"), F.col("predicate").alias("b"), F.col("object").alias("c"))
    one = flat(store.node(g, "NATION:3"), "category").select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("category").alias("b"), F.lit("").alias("c"))
    return one.unionByName(e("in", store.in_edges(g, "NATION:3"))).unionByName(e("out", store.out_edges(g, "NATION:3"))).unionByName(e("edge", store.edge(g, "NATION:3", region, f"NATION:3-{NS}:part_of-{region}")))


@query("{W} select id, name from n where name is not null")
def attributes(spark, d):
    return store.attributes(nodes(spark, d), ["id"], "name")


@query("{W}, u as (select id, name, null as brand from n where provided_by <> 'part' union all select 'PART:' || p_partkey, p_name, p_brand from part union all select id, name, null from n where provided_by = 'region') select * from u")
def concatenated(spark, d):
    """Inputs one after another: no record is merged, columns are united."""
    n, e = nodes(spark, d).select("id", "name", "provided_by"), edges(spark, d)
    p = read(spark, d, "part").select(_key("PART", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    parts = [KG(n.filter("provided_by <> 'part'"), e), KG(p, e), KG(n.filter("provided_by = 'region'"), e)]
    return transformer.concatenated(parts, "all").nodes.select("id", "name", "brand")


@query("{W} select id from n where id in (select subject from e union select object from e) and id not like 'ORD:%' union all select 'ORD:' || o_orderkey from orders")
def operations_by_name(spark, d):
    """Operations of a configuration, by dotted name, and one that the program adds."""
    transformer.OPERATIONS["only_named_or_ordered"] = lambda g, prefix: g.with_(nodes=g.nodes.filter(F.col("name").isNotNull() | F.col("id").startswith(prefix)))
    steps = [{"name": "any.module.remove_singleton_nodes"}, {"name": "only_named_or_ordered", "args": {"prefix": "ORD:"}}]
    return transformer.operate(graph(spark, d), steps).nodes.select("id")


@query("{W} select id from n where provided_by = 'customer'")
def added_formats(spark, d):
    """A source and a sink that the program registers."""
    held: dict[str, KG] = {}
    transformer.SOURCES["tables"] = lambda spark, s: graph(spark, s["folder"])
    transformer.SINKS["held"] = lambda kg, t: held.update({t["under"]: kg})
    transformer.transform(spark, {"format": "tables", "folder": d, "node_filters": {"provided_by": "customer"}}, {"format": "held", "under": "x"}, stream=True)
    return held["x"].nodes.select("id")


# --- records at import ------------------------------------------------------------------


@query(
    "select 'node' as kind, 'CUST:' || c_custkey as a, case when c_custkey % 5 = 0 then '{B}:NamedThing' else '{B}:Agent' end as b, '' as c from customer where c_custkey % 7 <> 0 union all "
    "select 'edge', 'CUST:' || c_custkey, '{B}:located_in', 'NATION:' || c_nationkey from customer where c_custkey % 3 <> 0 and c_nationkey <> 1 union all "
    "select 'finding', '', 'MISSING_NODE_PROPERTY', 'ERROR' from customer where c_custkey % 7 = 0 union all select 'finding', 'CUST:' || c_custkey, 'MISSING_CATEGORY', 'WARNING' from customer where c_custkey % 5 = 0 and c_custkey % 7 <> 0 union all "
    "select 'finding', 'CUST:' || c_custkey || '-' || 'NATION:' || c_nationkey, 'MISSING_EDGE_PREDICATE', 'ERROR' from customer where c_custkey % 3 = 0 and c_nationkey <> 1 union all "
    "select 'finding', 'CUST:' || c_custkey || '-', 'MISSING_EDGE_PROPERTY', 'ERROR' from customer where c_nationkey = 1 union all "
    "select 'finding', 'CUST:' || c_custkey || '-', 'MISSING_EDGE_PREDICATE', 'ERROR' from customer where c_nationkey = 1 and c_custkey % 3 = 0"
)
def dropped_records(spark, d):
    """Records without what they need are left out and reported; defaults are filled in."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    n = c.select(F.when(k % 7 != 0, _key("CUST", "c_custkey")).alias("id"), F.when(k % 5 != 0, F.lit(f"{NS}:Agent")).alias("category"), F.lit(0).alias("seq"))
    e = c.select(_key("CUST", "c_custkey").alias("subject"), F.when(k % 3 != 0, f"{NS}:located_in").alias("predicate"), F.when(F.col("c_nationkey") != 1, _key("NATION", "c_nationkey")).alias("object"), F.lit(0).alias("seq"))
    g = finish(n, e, ReadOptions(), "g", spark)
    row = lambda df, kind, a, b, x: df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), x.alias("c"))
    out = row(g.nodes, "node", F.col("id"), F.concat_ws("|", "category"), F.lit("")).unionByName(row(g.edges, "edge", F.col("subject"), F.col("predicate"), F.col("object")))
    found = validate.dropped_nodes(n).unionByName(validate.dropped_edges(e))
    return out.unionByName(row(found, "finding", F.col("entity"), F.col("kind"), F.col("level")))


@query("{W} select distinct subject, predicate, object, 'infores:x-' || aks as knowledge_source, case aks when 'customer' then 'infores:clients' else 'infores:' || aks end as aggregator_knowledge_source, 'infores:whole' as primary_knowledge_source from e")
def edge_provenance(spark, d):
    """A prefix, a pattern of one source, and a default."""
    e = edges(spark, d).select("subject", "predicate", "object", F.col("aks").alias("knowledge_source"), F.array("aks").alias("aggregator_knowledge_source")).distinct()
    p = provenance.Provenance({"knowledge_source": ("", "", "x"), "aggregator_knowledge_source": {"^customer$": ("customer", "clients"), ".": True}, "primary_knowledge_source": "infores:whole"})
    return flat(p.edges(e), "aggregator_knowledge_source").select("subject", "predicate", "object", "knowledge_source", "aggregator_knowledge_source", "primary_knowledge_source")


@query("{W}, x as (select distinct subject, predicate, object from e), h as (select *, sha256(subject || chr(1) || predicate || chr(1) || object) as h from x) select subject, predicate, object, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] as id from h")
def edge_identifiers(spark, d):
    e = edges(spark, d).select("subject", "predicate", "object").distinct()
    return normalize.with_edge_ids(e, stable=True).select("subject", "predicate", "object", "id")


@query("{W} select id, id || '#f' as iri, true as with_fragment, false as without, replace(id, ':', '/') as ref, id as back, replace(id, ':', '_') as key from n")
def identifier_forms(spark, d):
    n = nodes(spark, d).select("id", F.concat("id", F.lit("#f")).alias("iri"), F.regexp_replace("id", ":", "/").alias("ref"))
    return n.select("id", "iri", curie.has_fragment("iri").alias("with_fragment"), curie.has_fragment("id").alias("without"), "ref", curie.arango_curie("ref").alias("back"), curie.safe_key("ref").alias("key"))


@query("select p_partkey, list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') as camel, lower(p_type) as sentence from part")
def camel_cases(spark, d):
    p = read(spark, d, "part").select("p_partkey", curie.sentence_to_camel(F.lower("p_type")).alias("camel"))
    return p.select("p_partkey", "camel", curie.camel_to_sentence("camel").alias("sentence"))


# --- reports ------------------------------------------------------------------------------


@query(
    "{W}, t as (select s.category as sc, predicate, o.category as oc, aks from e join n s on s.id = subject join n o on o.id = object) "
    "select 'nodes' as part, '' as a, '' as b, count(*) as k from n union all select 'category', category, '', count(*) from n group by all union all select 'prefix', category, split_part(id, ':', 1), count(*) from n group by all union all "
    "select 'facet', category, provided_by, count(*) from n group by all union all select 'prefixes', split_part(id, ':', 1), '', count(*) from n group by all union all select 'edges', '', '', count(*) from t union all "
    "select 'predicate', predicate, '', count(*) from e group by all union all select 'triple', sc || '-' || predicate || '-' || oc, '', count(*) from t group by all union all select 'edge facet', sc || '-' || predicate || '-' || oc, aks, count(*) from t group by all"
)
def summary_document(spark, d):
    """The graph summary as a document, line by line."""
    s = transformer.graph_report(graph(spark, d), "summary", ("provided_by",), ("aks",))
    n, e = s["node_stats"], s["edge_stats"]
    out = [("nodes", "", "", n["total_nodes"]), ("edges", "", "", e["total_edges"])]
    for c, x in n["count_by_category"].items():
        out += [("category", c, "", x["count"]), *(("prefix", c, p, k) for p, k in x["count_by_id_prefix"].items()), *(("facet", c, v, y["count"]) for v, y in x["provided_by"].items())]
    out += [("prefixes", p, "", k) for p, k in n["count_by_id_prefixes"].items()]
    out += [("predicate", p, "", x["count"]) for p, x in e["count_by_predicates"].items()]
    for t, x in e["count_by_spo"].items():
        out += [("triple", t, "", x["count"]), *(("edge facet", t, v, y["count"]) for v, y in x["aks"].items())]
    return spark.createDataFrame(out, "part string, a string, b string, k long")


@query(
    "{W}, t as (select s.category as sc, predicate, o.category as oc, aks from e join n s on s.id = subject join n o on o.id = object) select 'node' as part, category as a, '' as b, count(*) as k from n group by all union all "
    "select distinct 'prefix', category, split_part(id, ':', 1), 0 from n union all select 'source', category, provided_by, count(*) from n group by all union all select 'edge', sc || ' ' || predicate || ' ' || oc, '', count(*) from t group by all union all "
    "select 'edge source', sc || ' ' || predicate || ' ' || oc, aks, count(*) from t group by all"
)
def meta_document(spark, d):
    """The meta graph as a document, line by line."""
    m = transformer.graph_report(graph(spark, d), "meta-knowledge-graph", ("provided_by",), ("aks",))
    out = []
    for c, x in m["nodes"].items():
        out += [("node", c, "", x["count"]), *(("prefix", c, p, 0) for p in x["id_prefixes"]), *(("source", c, v, k) for v, k in x["count_by_source"]["provided_by"].items())]
    for x in m["edges"]:
        t = f"{x['subject']} {x['predicate']} {x['object']}"
        out += [("edge", t, "", x["count"]), *(("edge source", t, v, k) for v, k in x["count_by_source"]["aks"].items())]
    return spark.createDataFrame(out, "part string, a string, b string, k long")


@query("{W} select id, kind, level, message from (select id, 'INVALID_CATEGORY' as kind, 'ERROR' as level, 'Category ''' || bad || ''' ' || why as message from (select 'PART:' || p_partkey as id, case p_partkey % 5 when 0 then '{B}:gene' when 1 then '{B}:OntologyClass' when 2 then '{B}:Unheard' when 3 then '{B}:Gene' else '{B}:NamedThing' end as bad, case p_partkey % 5 when 0 then 'is not in CamelCase form' when 1 then 'is a mixin' when 2 then 'is unknown' end as why from part) where why is not null)")
def category_findings(spark, d):
    k = F.col("p_partkey") % 5
    c = F.when(k == 0, "gene").when(k == 1, "OntologyClass").when(k == 2, "Unheard").when(k == 3, "Gene").otherwise("NamedThing")
    p = read(spark, d, "part").select(_key("PART", "p_partkey").alias("id"), F.array(F.concat(F.lit(f"{NS}:"), c)).alias("category"))
    return validate.bad_categories(p).select(F.col("entity").alias("id"), "kind", "level", "message")


@query("select 'A:' || p_partkey || '-B:1' as entity, 'Predicate ''' || p || ''' ' || case when p = '{B}:Interacts' then 'is not in snake_case form' else 'is unknown' end as message from (select p_partkey, case p_partkey % 3 when 0 then '{B}:Interacts' when 1 then '{B}:never_heard_of' else '{B}:related_to' end as p from part) where p <> '{B}:related_to'")
def predicate_findings(spark, d):
    k = F.col("p_partkey") % 3
    e = read(spark, d, "part").select(_key("A", "p_partkey").alias("subject"), F.concat(F.lit(f"{NS}:"), F.when(k == 0, "Interacts").when(k == 1, "never_heard_of").otherwise("related_to")).alias("predicate"), F.lit("B:1").alias("object"))
    return validate.bad_predicates(e).select("entity", "message")


@query(
    "select 'PART:' || p_partkey as entity, 'INVALID_NODE_PROPERTY_VALUE_TYPE' as kind, m as message from part, (select unnest(['Multi-valued property ''synonym'' is defined as string', 'Single-valued property ''name'' is defined as int']) as m) where m not like '%synonym%' or p_partkey % 2 = 0 union all "
    "select 'PART:' || p_partkey || '-X:1', 'INVALID_EDGE_PROPERTY_VALUE_TYPE', m from part, (select unnest(['Boolean property ''negated'' is defined as string', 'Multi-valued property ''publications'' is defined as string']) as m)"
)
def type_findings(spark, d):
    p = read(spark, d, "part")
    n = p.select(_key("PART", "p_partkey").alias("id"), F.col("p_size").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("synonym"))
    e = p.select(_key("PART", "p_partkey").alias("subject"), F.lit("X:1").alias("object"), F.lit("no").alias("negated"), F.col("p_brand").alias("publications"))
    return validate.wrong_types(n, False).unionByName(validate.wrong_types(e, True)).select("entity", "kind", "message")


@query(
    "with x as (select case c_custkey % 3 when 0 then 'CUST:' || c_custkey when 1 then 'cust ' || c_custkey else 'ZZ:' || c_custkey end as s, case c_custkey % 2 when 0 then 'NATION:' || c_nationkey else 'YY:' || c_nationkey end as o from customer) "
    "select s || '-' || o as entity, 'ERROR' as level, 'Property ''subject'' is not a CURIE' as message from x where s not like '%:%' union all select s || '-' || o, 'WARNING', 'Property ''subject'' has the unknown prefix ''ZZ''' from x where s like 'ZZ:%' union all "
    "select s || '-' || o, 'WARNING', 'Property ''object'' has the unknown prefix ''YY''' from x where o like 'YY:%'"
)
def edge_id_findings(spark, d):
    k = F.col("c_custkey")
    s = F.when(k % 3 == 0, _key("CUST", "c_custkey")).when(k % 3 == 1, F.concat(F.lit("cust "), k.cast("string"))).otherwise(_key("ZZ", "c_custkey"))
    e = read(spark, d, "customer").select(s.alias("subject"), F.when(k % 2 == 0, _key("NATION", "c_nationkey")).otherwise(_key("YY", "c_nationkey")).alias("object"))
    return validate.bad_ids(e, ("subject", "object"), True, {"CUST", "NATION"}).select("entity", "level", "message")


# --- cliques ----------------------------------------------------------------------------------


def _fives(spark, d) -> KG:
    """Customers five by five are the same; the third carries the annotation in odd groups."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    group = F.floor(k / 5)
    n = c.select(
        F.when(k % 2 == 0, _key("B", "c_custkey")).otherwise(_key("A", "c_custkey")).alias("id"), F.when((k % 5 == 2) & (group % 2 == 1), F.lit("true")).alias("clique_leader"), k.alias("k"),
        F.when(k % 5 == 0, F.array(F.lit(f"{NS}:Gene"))).when(k % 5 == 1, F.array(F.lit("my:gene"))).when(k % 5 == 2, F.lit(None)).otherwise(F.array(F.lit(f"{NS}:NamedThing"))).alias("category"),
    )
    head = n.select((F.floor(F.col("k") / 5)).alias("g"), F.col("id").alias("first"), "k").filter("k % 5 = 0").drop("k")
    e = n.filter("k % 5 <> 0").join(head, F.floor(F.col("k") / 5) == F.col("g")).select(F.col("first").alias("subject"), F.lit(clique.SAME).alias("predicate"), F.col("id").alias("object"))
    return KG(n.drop("k"), e)


FIVES = "f as (select c_custkey as k, c_custkey // 5 as g, case when c_custkey % 2 = 0 then 'B:' else 'A:' end || c_custkey as id from customer), c as (select * from f where g in (select g from f where k % 5 = 0 intersect select g from f where k % 5 <> 0)) "


@query("with " + FIVES + "select id, leader, how from (select id, case when g % 2 = 1 and count(*) filter (where k % 5 = 2) over w > 0 then min(id) filter (where k % 5 = 2) over w else coalesce(min(id) filter (where id like 'A:%') over w, min(id) over w) end as leader, case when g % 2 = 1 and count(*) filter (where k % 5 = 2) over w > 0 then 'LEADER_ANNOTATION' else 'ALPHABETICAL_SORT' end as how from c window w as (partition by g))")
def leaders_by_annotation_and_name(spark, d):
    g = _fives(spark, d)
    comp = clique.cliques(g, mapping={"my:gene": f"{NS}:Gene"})
    return comp.join(clique.leaders(g, comp), "clique").select("id", "leader", F.col("election_strategy").alias("how"))


@query("with " + FIVES + "select distinct min(id) over (partition by g) as clique, '{B}:Gene' as category, '{B}:NamedThing' as last, true as through from c")
def clique_category(spark, d):
    """The most specific category of a clique, and the union of all in order: names are
    mapped, and a node without a category takes that of an equivalent one."""
    g = _fives(spark, d)
    comp = clique.cliques(g, mapping={"my:gene": f"{NS}:Gene"})
    valid = clique.checked_categories(clique.with_categories(g, clique.equivalences(g), {"my:gene": f"{NS}:Gene"}))
    k = clique.clique_categories(comp, valid)
    within = F.array_contains("categories", f"{NS}:BiologicalEntity") & (F.element_at("categories", 1) == f"{NS}:Gene")
    named = F.filter("categories", lambda c: c.isin(f"{NS}:Gene", f"{NS}:BiologicalEntity", f"{NS}:NamedThing"))
    return k.select("clique", "category", F.element_at(named, -1).alias("last"), within.alias("through"))


@query(
    "select 'PART:' || p_partkey as id, case p_partkey % 4 when 0 then '{B}:NamedThing|{B}:Gene' when 1 then '{B}:Gene' when 2 then '' else '{B}:Disease' end as valid, case p_partkey % 4 when 1 then '{B}:Disease' else '' end as outside, "
    "case p_partkey % 4 when 2 then 'x:Nothing|{B}:OntologyClass' else '' end as unknown from part"
)
def checked_categories(spark, d):
    k = F.col("p_partkey") % 4
    lists = {0: ("NamedThing", "Gene"), 1: ("Gene", "Disease"), 2: ("x:Nothing", "OntologyClass"), 3: ("Disease",)}
    c = F.lit(None)
    for i, names in lists.items():
        c = F.when(k == i, F.array(*[F.lit(n if ":" in n else f"{NS}:{n}") for n in names])).otherwise(c)
    p = read(spark, d, "part").select(_key("PART", "p_partkey").alias("id"), c.alias("category"))
    return flat(clique.checked_categories(p), "valid", "outside", "unknown")


@query(
    "{W}, k as (select n.id, case when provided_by in ('customer', 'supplier') or provided_by = 'nation' then '{B}:PlanetaryEntity' when provided_by = 'region' then '{B}:PlanetaryEntity' end as category from n) select id, category from k where category is not null"
)
def inferred_categories(spark, d):
    """Of the region that a place is part of, at any distance."""
    top = {f"REGION:{r.r_regionkey}": f"{NS}:PlanetaryEntity" for r in read(spark, d, "region").collect()}
    return closure.inferred_categories(graph(spark, d), top, (f"{NS}:part_of", f"{NS}:located_in"))


@query("{W} select distinct subject, predicate, object, coalesce(name, object) as label from e left join n on id = object")
def curie_labels(spark, d):
    e = edges(spark, d).select("subject", "predicate", "object").distinct()
    return closure.labels(e, "object", nodes(spark, d).filter("name is not null").select("id", F.col("name").alias("label")))


@query("{W} select subject as id, object as parent from e where predicate in ('{B}:part_of', '{B}:located_in') group by all")
def parents(spark, d):
    return closure.parents(graph(spark, d), (f"{NS}:part_of", f"{NS}:located_in"))


@query("{W} select id, case when provided_by in ('region', 'nation') then 'first' else 'second' end as name from n")
def merge_target_is_largest(spark, d):
    """The graph of most edges is the target, whose single values stay."""
    g = graph(spark, d)
    few = g.edges.filter(f"predicate = '{NS}:part_of'").select("subject", "predicate", "object")
    small = KG(g.nodes.select("id", F.lit("first").alias("name")), few, "small")
    large = KG(g.nodes.filter("provided_by not in ('region', 'nation')").select("id", F.lit("second").alias("name")), g.edges.select("subject", "predicate", "object"), "large")
    return merge.merge_all([small, large]).nodes.select("id", F.concat_ws("|", "name").alias("name"))


# --- streams --------------------------------------------------------------------------------------


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by all")
def stream_tumbling_windows(spark, d):
    return streams.windows(spark, f"{d}/events.parquet", "ts", "event_type", "1 day")


@query("select start, event_type, count(*) as n from (select event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 12 hour, date_trunc('day', ts) + interval 12 hour]) as start, ts from events) where ts >= start and ts < start + interval 1 day group by all")
def stream_sliding_windows(spark, d):
    return streams.windows(spark, f"{d}/events.parquet", "ts", "event_type", "1 day", slide="12 hours")


@query(
    "with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from o) "
    "select user_id, min(ts) as start, max(ts) + interval 6 hour as stop, count(*) as n from s group by user_id, k"
)
def stream_sessions(spark, d):
    """Sessions that end six hours after a user's last event."""
    return streams.sessions(spark, f"{d}/events.parquet", "ts", "user_id", "6 hours")


@query("{W} select category, split_part(id, ':', 1) as prefix, count(*) as n from n group by 1, 2")
def stream_summary(spark, d):
    """Nodes by category and prefix, counted as files arrive."""
    return streams.summarised(spark, nodes(spark, d))


@query("{W} select subject, predicate, object, max(aks) as aks, arg_max(quantity, seq * 1000 + quantity) as quantity from e group by 1, 2, 3")
def stream_upserts(spark, d):
    """Edges upserted batch by batch."""
    return streams.upserted(spark, edges(spark, d)).select("subject", "predicate", "object", "aks", "quantity")


@query("{W} select category, count(*) as n from n group by 1")
def inspected(spark, d):
    """A graph passed on to no output; an inspector sees it on the way."""
    seen = []
    transformer.transform(spark, {"format": "graph", "graph": graph(spark, d)}, {"format": "null"}, stream=True, inspector=lambda g: seen.append(summary.category_counts(g.nodes)))
    return seen[0]
