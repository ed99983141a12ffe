"""Queries over the driver's tables that exercise the operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curie
from ..functions.catalog import NS
from ..kg import KG
from ..operators import clique, closure, components, filters, merge, normalize, provenance, report, reshape, store, summary, validate
from ..streaming import streams
from ..sources import databases
from .registry import ORACLES, QUERIES, flat, query
from .views import WITH, edges, graph, nodes, read

__all__ = ["ORACLES", "QUERIES"]


@query("{W} select id, name, category, provided_by from n")
def kg_nodes(spark, d):
    return flat(nodes(spark, d), "category")


@query("{W} select subject, predicate, object, subject || '-' || predicate || '-' || object as edge_key, max(aks) as aks, arg_max(quantity, seq * 1000 + quantity) as quantity from e group by 1, 2, 3")
def kg_edges_dedup(spark, d):
    g = store.upsert(KG(nodes(spark, d).withColumn("seq", F.lit(0)), edges(spark, d)))
    return g.edges.select("subject", "predicate", "object", "edge_key", "aks", "quantity")


@query("{W} select (select count(*) from n) as nodes, (select count(*) from (select distinct subject, object, predicate from e)) as edges")
def graph_counts(spark, d):
    g = store.upsert(KG(nodes(spark, d).withColumn("seq", F.lit(0)), edges(spark, d)))
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges")))


@query("{W} select category, count(*) as n from n group by 1")
def node_category_counts(spark, d):
    return summary.category_counts(nodes(spark, d))


@query("{W} select split_part(id, ':', 1) as prefix, count(*) as n from n group by 1")
def id_prefix_counts(spark, d):
    return summary.prefix_counts(nodes(spark, d)).groupBy("prefix").agg(F.sum("n").alias("n"))


@query("{W} select category, split_part(id, ':', 1) as prefix, count(*) as n from n group by 1, 2")
def prefix_by_category(spark, d):
    return summary.prefix_counts(nodes(spark, d))


@query("{W} select category, provided_by as value, count(*) as n from n group by 1, 2")
def source_counts(spark, d):
    return summary.node_facets(nodes(spark, d), "provided_by")


@query(
    "{W} select s.category as subject_category, predicate, o.category as object_category, aks as value, count(*) as n "
    "from e join n s on s.id = subject join n o on o.id = object group by all"
)
def facet_counts(spark, d):
    return summary.edge_facets(graph(spark, d), "aks")


@query("{W} select predicate, count(*) as n from e group by 1")
def predicate_counts(spark, d):
    return summary.predicate_counts(edges(spark, d))


SPO = "select s.category as subject_category, predicate, o.category as object_category, count(*) as n from e join n s on s.id = subject join n o on o.id = object group by all"


@query("{W} " + SPO)
def spo_counts(spark, d):
    return summary.triple_counts(graph(spark, d))


@query("{W} select category, string_agg(distinct split_part(id, ':', 1), '|' order by split_part(id, ':', 1)) as id_prefixes, count(*) as n from n group by 1")
def meta_node_stats(spark, d):
    return flat(summary.meta_nodes(graph(spark, d)), "id_prefixes")


@query("{W} select s.category as subject_category, predicate, o.category as object_category, string_agg(distinct aks, '|' order by aks) as relations, count(*) as n from e join n s on s.id = subject join n o on o.id = object group by all")
def meta_edge_stats(spark, d):
    g = graph(spark, d)
    return flat(summary.meta_edges(g.with_(edges=g.edges.withColumnRenamed("aks", "relation"))), "relations")


@query(
    "{W}, t as (" + SPO + "), c as (select category, count(*) k from n group by 1) select (select count(*) from n) as nodes, (select count(*) from c) as categories, "
    "(select sum(k)::bigint from c) as nodes_by_category, (select count(*) from e) as edges, (select count(distinct predicate) from t) as predicates, "
    "(select count(*) from t) as triples, (select sum(n)::bigint from t) as edges_by_triple"
)
def meta_graph_totals(spark, d):
    return summary.MetaGraph(graph(spark, d)).totals()


@query("{W} select id, count(*) as n from (select id from n union all select subject from e where predicate = '{B}:provides') group by 1 having count(*) > 1")
def duplicate_nodes(spark, d):
    again = edges(spark, d).filter(f"predicate = '{NS}:provides'").select(F.col("subject").alias("id"))
    return summary.duplicate_nodes(nodes(spark, d).select("id").unionByName(again))


@query("select 'USER:' || user_id as id, arg_min(event_type, event_id) as event_type, min(event_id) as event_id from events group by 1")
def first_record(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("USER:"), F.col("user_id").cast("string")).alias("id"), "event_type", "event_id", F.col("event_id").alias("seq"))
    return store.first_records(e, ("id",), "seq")


@query("{W} select id, category from n where category in ('{B}:Agent', '{B}:Event')")
def node_filter_category(spark, d):
    g = filters.Filters.of(nodes={"category": {f"{NS}:Agent", f"{NS}:Event"}}).apply(graph(spark, d))
    return flat(g.nodes.select("id", "category"), "category")


@query("{W} select subject, predicate, object, seq from e where predicate = '{B}:located_in'")
def edge_filter_predicate(spark, d):
    return filters.Filters.of(edges={"predicate": f"{NS}:located_in"}).apply(graph(spark, d)).edges.select("subject", "predicate", "object", "seq")


@query("{W} select subject, predicate, object, seq from e where contains(predicate, 'part') or contains(predicate, 'input')")
def edge_filter_substring(spark, d):
    return filters.Filters.of(edges={"predicate": {"part", "input"}}).apply(graph(spark, d)).edges.select("subject", "predicate", "object", "seq")


@query("{W} select subject, predicate, object, seq from e where subject in (select id from n where category = '{B}:Agent')")
def endpoint_gate_subject(spark, d):
    return filters.Filters.of(edges={"subject_category": {f"{NS}:Agent"}}).apply(graph(spark, d)).edges.select("subject", "predicate", "object", "seq")


@query("{W}, k as (select id from n where category in ('{B}:Agent', '{B}:GeographicLocation')) select subject, predicate, object, seq from e where subject in (from k) and object in (from k)")
def endpoint_gate_both(spark, d):
    return filters.Filters.of(nodes={"category": {f"{NS}:Agent", f"{NS}:GeographicLocation"}}).apply(graph(spark, d)).edges.select("subject", "predicate", "object", "seq")


@query("{W}, x as (select subject as id from e union all select object from e), c as (select id, count(*) as k from x group by 1) select n.id, coalesce(k, 0) as degree from n left join c using (id)")
def degree(spark, d):
    return store.degrees(graph(spark, d))


@query("{W}, k as (select subject as id from e union select object from e) select n.id from n where id in (from k) and provided_by <> 'nowhere'")
def singleton_removal(spark, d):
    lonely = nodes(spark, d).limit(0).unionByName(read(spark, d, "customer").select(F.concat(F.lit("LONE:"), F.col("c_custkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("name"), F.array(F.lit("x")).alias("category"), F.lit("nowhere").alias("provided_by")))
    g = graph(spark, d)
    return reshape.remove_singletons(g.with_(nodes=g.nodes.unionByName(lonely))).nodes.select("id")


@query("{W} select distinct object as id from e where split_part(object, ':', 1) = 'PART'")
def dangling_nodes(spark, d):
    return store.dangling(KG(nodes(spark, d, leave_out=("part",)), edges(spark, d)))


@query("{W} select id, case when provided_by = 'part' then '{B}:NamedThing' else category end as category from n where provided_by <> 'part' union all select distinct object, '{B}:NamedThing' from e where split_part(object, ':', 1) = 'PART'")
def implicit_endpoints(spark, d):
    return flat(store.with_endpoints(KG(nodes(spark, d, leave_out=("part",)), edges(spark, d))).nodes.select("id", "category"), "category")


@query("{W} select subject, predicate, object, seq from e where not (contains(subject, 'SUPP:') or contains(object, 'SUPP:'))")
def remove_nodes(spark, d):
    gone = nodes(spark, d).filter("provided_by = 'supplier'").select("id")
    return store.remove_nodes(graph(spark, d), gone).edges.select("subject", "predicate", "object", "seq")


@query("{W} select id, case when provided_by = 'nation' then 'renamed ' || name else name end as name from n")
def set_attributes(spark, d):
    new = nodes(spark, d).filter("provided_by = 'nation'").select("id", F.concat(F.lit("renamed "), F.col("name")).alias("name"))
    return store.set_attributes(nodes(spark, d).select("id", "name"), ["id"], new)


@query("{W} select distinct replace(subject, 'SUPP:', 'VENDOR:') as subject, predicate, object from e")
def relabel_nodes(spark, d):
    g = graph(spark, d)
    m = nodes(spark, d).filter("provided_by = 'supplier'").select(F.col("id").alias("old"), F.regexp_replace("id", "^SUPP:", "VENDOR:").alias("new"))
    return store.relabel(g.with_(edges=g.edges.drop("seq")), m).edges.select("subject", "predicate", "object")


@query("{W} select distinct case when subject like 'CUST:%' then 'MKT:' || split_part(subject, ':', 2) else subject end as subject, predicate, case when object like 'CUST:%' then 'MKT:' || split_part(object, ':', 2) else object end as object from e")
def remap_identifier(spark, d):
    g = graph(spark, d)
    alt = F.when(F.col("id").startswith("CUST:"), F.array(F.regexp_replace("id", "^CUST:", "ALT:"), F.regexp_replace("id", "^CUST:", "MKT:")))
    g = g.with_(nodes=g.nodes.withColumn("xref", alt), edges=g.edges.select("subject", "predicate", "object"))
    return reshape.remap_identifiers(g, f"{NS}:Agent", "xref", "MKT:").edges.select("subject", "predicate", "object")


@query("{W} select id, case when category = '{B}:Agent' then provided_by else null end as description from n")
def remap_node_property(spark, d):
    g = graph(spark, d)
    g = g.with_(nodes=g.nodes.withColumn("description", F.lit(None).cast("string")))
    return reshape.remap_node_property(g, f"{NS}:Agent", "description", "provided_by").nodes.select("id", "description")


@query("{W} select subject, predicate, object, seq, case when predicate = '{B}:provides' then aks else predicate end as relation from e")
def remap_edge_property(spark, d):
    g = graph(spark, d)
    g = g.with_(edges=g.edges.withColumn("relation", F.col("predicate")))
    return reshape.remap_edge_property(g, f"{NS}:provides", "relation", "aks").edges.select("subject", "predicate", "object", "seq", "relation")


@query("{W}, v as (select subject, min(object) as value from e where predicate = '{B}:located_in' group by 1) select id, value as located_in from n left join v on id = subject")
def fold_predicate(spark, d):
    return reshape.fold_predicate(graph(spark, d), f"{NS}:located_in", remove_prefix=True).nodes.select("id", "located_in")


@query("{W} select subject, predicate, object from e union all select id, '{B}:provided_by', provided_by from n")
def unfold_property(spark, d):
    g = graph(spark, d)
    g = g.with_(edges=g.edges.select("subject", "predicate", "object"))
    return reshape.unfold_property(g, "provided_by", f"{NS}").edges.select("subject", "predicate", "object")


PRIORITY = ("1-URGENT", "2-HIGH")


def _two_graphs(spark, d):
    """Customers by name, and again with their segment as name and their nation listed."""
    c = read(spark, d, "customer")
    key = F.concat(F.lit("CUST:"), F.col("c_custkey").cast("string")).alias("id")
    a = c.select(key, F.col("c_name").alias("name"), F.array(F.lit("a")).alias("synonym"), F.col("c_mktsegment").alias("note"))
    b = c.select(key, F.col("c_mktsegment").alias("name"), F.array(F.col("c_mktsegment"), F.lit("a")).alias("synonym"), F.col("c_name").alias("note"))
    e = read(spark, d, "customer").select(key.alias("subject"), F.lit(f"{NS}:located_in").alias("predicate"), F.concat(F.lit("NATION:"), F.col("c_nationkey").cast("string")).alias("object"))
    return KG(a, e, "a"), KG(b, e, "b")


@query("select 'CUST:' || c_custkey as id, c_name as name, 'a|' || c_mktsegment as synonym, c_mktsegment || '|' || c_name as note from customer")
def merge_preserve(spark, d):
    return flat(merge.merge(list(_two_graphs(spark, d)), preserve=True).nodes, "synonym", "note")


@query("select 'CUST:' || c_custkey as id, c_name as name, 'a|' || c_mktsegment as synonym, c_name as note from customer")
def merge_replace(spark, d):
    return flat(merge.merge(list(_two_graphs(spark, d)), preserve=False).nodes, "synonym")


@query("select 'CUST:' || c_custkey as subject, '{B}:located_in' as predicate, 'NATION:' || c_nationkey as object, 'CUST:' || c_custkey || '-{B}:located_in-NATION:' || c_nationkey as edge_key from customer")
def merge_edges(spark, d):
    return merge.merge_all(list(_two_graphs(spark, d))).edges


def _equivalent(spark, d) -> KG:
    """Customers five by five, and a supplier with each fifth one, are the same."""
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    k = F.col("c_custkey")
    pair = c.filter(k % 5 != 0).select(F.concat(F.lit("CUST:"), k.cast("string")).alias("id"), F.array(F.concat(F.lit("CUST:"), (k - k % 5).cast("string"))).alias("same_as"))
    five = s.select(F.concat(F.lit("SUPP:"), F.col("s_suppkey").cast("string")).alias("subject"), F.lit(clique.SAME).alias("predicate"), F.concat(F.lit("CUST:"), (F.col("s_suppkey") * 5).cast("string")).alias("object"))
    g = graph(spark, d)
    return KG(g.nodes.join(pair, "id", "left"), g.edges.select("subject", "predicate", "object", "aks").unionByName(five, allowMissingColumns=True))


GROUP = "c as (select 'CUST:' || c_custkey as id, c_custkey - c_custkey % 5 as k from customer union all select 'SUPP:' || s_suppkey, s_suppkey * 5 from supplier), m as (select * from c where k in (select k from c group by k having count(*) > 1))"


@query("with " + GROUP + " select id, min(id) over (partition by k) as component from m")
def clique_components(spark, d):
    return components.connected_components(clique.equivalences(_equivalent(spark, d)), "a", "b").toDF("id", "component")


LEADER = GROUP + ", l as (select id, coalesce(min(case when id like 'SUPP:%' then id end) over (partition by k), min(id) over (partition by k)) as leader from m)"


@query("with " + LEADER + " select id, leader, 'PREFIX_PRIORITIZATION' as election_strategy from l")
def clique_leaders(spark, d):
    g = _equivalent(spark, d)
    c = clique.cliques(g)
    return c.join(clique.leaders(g, c, priority=["SUPP", "CUST"]), "clique").select("id", "leader", "election_strategy")


@query(
    WITH + ", " + LEADER + ", x as (select coalesce(a.leader, subject) as subject, predicate, coalesce(b.leader, object) as object from e left join l a on a.id = subject left join l b on b.id = object) "
    "select distinct subject, predicate, object from x"
)
def clique_consolidated_edges(spark, d):
    return clique.clique_merge(_equivalent(spark, d), priority=["SUPP", "CUST"]).edges.select("subject", "predicate", "object")


@query(WITH + ", " + LEADER + ", s as (select leader, string_agg(id, '|' order by id) as same_as from l where id <> leader group by 1) select n.id, s.same_as from n left join s on n.id = s.leader where n.id not in (select id from l where id <> leader)")
def clique_nodes(spark, d):
    out = clique.clique_merge(_equivalent(spark, d), priority=["SUPP", "CUST"]).nodes
    return out.select("id", F.when(F.size("same_as") > 0, F.concat_ws("|", "same_as")).alias("same_as"))


@query(
    "{W}, r as (select subject as id, object as ancestor, 1 as distance from e where predicate in ('{B}:part_of', '{B}:located_in') "
    "union select r.id, e.object, distance + 1 from r join e on e.subject = r.ancestor and e.predicate in ('{B}:part_of', '{B}:located_in')) "
    "select id, ancestor, min(distance)::int as distance from r group by 1, 2"
)
def ancestors_closure(spark, d):
    return closure.ancestors(graph(spark, d), relations=(f"{NS}:part_of", f"{NS}:located_in"))


@query("select p_partkey, 'infores:' || replace(regexp_replace(regexp_replace(regexp_replace(lower(trim('made by ' || p_brand || '. ' || p_type)), '\\s+', '_', 'g'), '\\.+', '_', 'g'), '[^\\w]', '', 'g'), '_', '-') as source from part")
def infores_rewrite(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat_ws(". ", "p_brand", "p_type").alias("s"))
    return p.select("p_partkey", provenance.infores(F.col("s"), prefix="made by").alias("source"))


@query("{W} select id, category, case when provided_by = 'part' then 'infores:part' else 'infores:' || provided_by end as provided_by from n")
def node_provenance(spark, d):
    n = provenance.Provenance({"provided_by": True}).nodes(nodes(spark, d))
    return flat(n.select("id", "category", "provided_by"), "category", "provided_by")


@query("{W} select id, split_part(id, ':', 1) as prefix, split_part(id, ':', 2) as reference, true as curie, false as iri from n")
def curie_parts(spark, d):
    n = nodes(spark, d)
    return n.select("id", curie.prefix_of("id").alias("prefix"), curie.reference_of("id").alias("reference"), curie.is_curie("id").alias("curie"), curie.is_iri("id").alias("iri"))


@query("{W} select id, case when id like 'CUST:%' then 'http://example.org/customer/' || split_part(id, ':', 2) when id like 'SUPP:%' then 'http://example.org/supplier#' || split_part(id, ':', 2) else id end as iri, id as back from n")
def contract_expand(spark, d):
    m = {"CUST": "http://example.org/customer/", "SUPP": "http://example.org/supplier#", "X": "http://example.org/"}
    n = nodes(spark, d).select("id", curie.expand("id", m).alias("iri"))
    return n.select("id", "iri", curie.contract("iri", m).alias("back"))


@query("select p_partkey, lower(p_type) as sentence, replace(lower(p_type), ' ', '_') as snake, '{B}:' || replace(lower(p_type), ' ', '_') as slot from part")
def name_cases(spark, d):
    p = read(spark, d, "part").withColumn("snake", curie.sentence_to_snake("p_type"))
    return p.select("p_partkey", curie.snake_to_sentence("snake").alias("sentence"), "snake", curie.slot_curie("p_type").alias("slot"))


@query(
    "select o_orderkey, list_aggregate(list_sort(list_distinct(list_filter(string_split(o_orderstatus || '|' || o_orderpriority || '|' || o_orderstatus || '|', '|'), lambda x: x <> ''))), 'string_agg', '|') as synonym, "
    "o_orderstatus || '|' || o_orderpriority || '|' || o_orderstatus as other from orders"
)
def sanitize_lists(spark, d):
    o = read(spark, d, "orders")
    raw = F.concat_ws("|", "o_orderstatus", "o_orderpriority", "o_orderstatus", F.lit(""))
    return flat(normalize.sanitize_import(o.select("o_orderkey", raw.alias("synonym"), raw.alias("other"))).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "synonym", "other"), "synonym", "other")


@query("select c_custkey::varchar as c_custkey, c_name || '|' || c_mktsegment as synonym, nullif(c_nationkey, 0)::varchar as nation from customer where c_custkey <> 0 union all select null, c_name || '|' || c_mktsegment, nullif(c_nationkey, 0)::varchar from customer where c_custkey = 0")
def export_rows(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("synonym"), F.col("c_nationkey").alias("nation"))
    return normalize.sanitize_export(c)


VALID_N = (
    "select id as entity, 'WARNING' as level, 'INVALID_NODE_PROPERTY_VALUE' as kind, 'Property ''id'' has the unknown prefix ''' || split_part(id, ':', 1) || '''' as message from n where split_part(id, ':', 1) not in ('CUST', 'SUPP') "
    "union all select id, 'ERROR', 'MISSING_NODE_PROPERTY', 'Required property ''name'' is missing' from n where name is null"
)


@query("{W} " + VALID_N)
def validate_nodes(spark, d):
    return validate.validate_nodes(nodes(spark, d).drop("provided_by"), prefixes={"CUST", "SUPP"}, required=("id", "category", "name"))


@query("{W} select subject || '-' || object as entity, 'ERROR' as level, 'MISSING_EDGE_PROPERTY' as kind, 'Required property ''' || p || ''' is missing' as message from e, (select unnest(['knowledge_level', 'agent_type']) as p)")
def validate_edges(spark, d):
    e = edges(spark, d).select("subject", "predicate", "object")
    return validate.validate_edges(e, prefixes={"CUST", "SUPP", "NATION", "REGION", "ORD", "PART"}, required=("subject", "predicate", "object", "knowledge_level", "agent_type"))


@query("{W}, v as (" + VALID_N + ") select level, kind, message, count(distinct entity) as n from v group by all")
def error_rollup(spark, d):
    f = validate_nodes(spark, d)
    return report.roll_up(f).select("level", "kind", "message", "n")


@query("select 'USER:' || user_id as subject, '{B}:' || event_type as predicate, 'EVENT:' || event_id as object from events")
def events_as_edges(spark, d):
    e = read(spark, d, "events")
    return e.select(F.concat(F.lit("USER:"), F.col("user_id").cast("string")).alias("subject"), curie.slot_curie("event_type").alias("predicate"), F.concat(F.lit("EVENT:"), F.col("event_id").cast("string")).alias("object"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    "{W}, r as (select 'node' as kind, id as a, '' as b, '' as c, row_number() over (order by id) - 1 as k from n union all "
    "select 'edge', subject, predicate, object, (select count(*) from n) + row_number() over (order by seq, subject || '-' || predicate || '-' || object) - 1 from e where predicate = '{B}:provides') "
    "select kind, a, b, c from r where k >= 1000 and k < (select count(*) from n) + 500"
)
def page_range(spark, d):
    """A slice of the nodes, then the edges, that spans both."""
    e = edges(spark, d).filter(f"predicate = '{NS}:provides'").withColumn("edge_key", normalize.edge_key())
    g = KG(nodes(spark, d).withColumn("seq", F.lit(0)), e)
    cut = databases.sliced(g, 1000, g.nodes.count() + 500)
    n = cut.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))
    return n.unionByName(cut.edges.select(F.lit("edge").alias("kind"), F.col("subject").alias("a"), F.col("predicate").alias("b"), F.col("object").alias("c")))


@query("{W} select provided_by as source, 'infores:' || provided_by as infores from n group by 1")
def infores_catalog(spark, d):
    return provenance.infores_catalog(nodes(spark, d), "provided_by")


@query("select unnest(['id', 'name', 'category', 'provided_by']) as property")
def property_discovery(spark, d):
    """Columns that some node uses; ``note`` is empty throughout."""
    used = normalize.used_properties(nodes(spark, d).withColumn("note", F.lit(None).cast("string")))
    return spark.createDataFrame([(p,) for p in used], "property string")


@query("{W} select subject, predicate, object, seq from e where subject in (select id from n where category = '{B}:Agent')")
def stream_endpoint_gate(spark, d):
    return streams.gated_files(spark, graph(spark, d), {f"{NS}:Agent"}).select("subject", "predicate", "object", "seq")


@query("select event_type, count(*) as n from events group by 1")
def stream_event_counts(spark, d):
    return streams.counted(spark, f"{d}/events.parquet", "event_type")


from . import format_queries, operator_queries  # noqa: E402, F401 - they register theirs
