"""Statistics of a graph: categories, prefixes, sources, predicates, category triples.

Two rule sets exist. The graph summary counts what it cannot classify under ``unknown``;
the meta graph leaves such records out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import NS
from ..functions.curie import prefix_of
from ..kg import KG
from ..session import stored
from .normalize import col
from .store import first_records

CATEGORY = rf"^{NS}:[A-Z][a-zA-Z]*$"
PREDICATE = rf"^{NS}:[a-z][a-z_]*$"
UNKNOWN = "unknown"


def as_list(df: DataFrame, name: str) -> Column:
    """A property as a list of strings; ``a|b`` in a value is two values."""
    if name not in df.columns:
        return F.lit(None).cast("array<string>")
    c = col(name)
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.flatten(F.transform(c.cast("array<string>"), lambda x: F.split(x, r"\|")))
    return F.split(c.cast("string"), r"\|")


def valid_categories(df: DataFrame) -> Column:
    """The well-formed categories of a node, each once; an empty list if there are none."""
    return F.coalesce(F.array_distinct(F.filter(as_list(df, "category"), lambda c: c.rlike(CATEGORY))), F.array().cast("array<string>"))


def first_nodes(kg: KG) -> DataFrame:
    """The first record of each id: by ``seq`` if there is one, else by all its values."""
    n = kg.nodes
    if "seq" in n.columns:
        return first_records(n, ("id",), "seq")
    rest = [c for c in n.columns if c != "id"]
    return n.groupBy("id").agg(F.min(F.struct(*[col(c) for c in rest])).alias("r")).select("id", *[F.col("r").getField(c).alias(c) for c in rest])


def node_rows(nodes: DataFrame, unknown: bool) -> DataFrame:
    """``id, category``, one row for each category of each node."""
    cats = valid_categories(nodes)
    if unknown:
        cats = F.when(F.size(F.coalesce(as_list(nodes, "category"), F.array().cast("array<string>"))) == 0, F.array(F.lit(UNKNOWN))).otherwise(cats)
    rest = [col(c) for c in nodes.columns if c not in ("id", "category")]
    return nodes.select("id", *rest, F.explode(cats).alias("category"))


def category_counts(nodes: DataFrame, unknown: bool = True) -> DataFrame:
    """``category, n``."""
    return node_rows(nodes, unknown).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def prefix_counts(nodes: DataFrame, unknown: bool = True) -> DataFrame:
    """``category, prefix, n``: nodes with a CURIE by prefix within category."""
    return node_rows(nodes, unknown).withColumn("prefix", prefix_of("id")).filter("prefix is not null").groupBy("category", "prefix").agg(F.count(F.lit(1)).alias("n"))


def facet_values(df: DataFrame, facet: str) -> Column:
    """Values of a facet as a list; ``[unknown]`` if there are none."""
    v = F.filter(as_list(df, facet), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(F.coalesce(v, F.array().cast("array<string>"))) > 0, v).otherwise(F.array(F.lit(UNKNOWN)))


def node_facets(nodes: DataFrame, facet: str, unknown: bool = True) -> DataFrame:
    """``category, value, n`` of one property."""
    rows = node_rows(nodes.withColumn("_facet", facet_values(nodes, facet)), unknown)
    return rows.select("category", F.explode("_facet").alias("value")).groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))


def predicate_counts(edges: DataFrame, unknown: bool = True) -> DataFrame:
    """``predicate, n``: well-formed predicates, and ``unknown`` for a missing one."""
    p = F.col("predicate")
    e = edges.filter(p.isNull() | p.rlike(PREDICATE)) if unknown else edges.filter(p.rlike(PREDICATE))
    return e.groupBy(F.coalesce(p, F.lit(UNKNOWN)).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


def grouped(kg: KG, unknown: bool = True, extra: Column | None = None) -> DataFrame:
    """``sc, predicate, oc, n``: edges by the lists of their ends' categories and by
    predicate, and by ``x`` where an expression on the edges is given. Edges with an end
    that is no node are left out.

    Edges are counted by the subject's categories before the objects are looked up, so
    that what is shuffled for them follows the distinct objects. The nodes, a row an id,
    are hashed and the edges stream past them, so that no join sorts or spills edges;
    adaptive execution splits hub nodes.
    """
    nodes = first_nodes(kg)
    cats = valid_categories(nodes)
    if unknown:
        cats = F.when(F.size(F.coalesce(as_list(nodes, "category"), F.array().cast("array<string>"))) == 0, F.array(F.lit(UNKNOWN))).otherwise(cats)
    look = nodes.select("id", cats.alias("c"))
    p = F.col("predicate")
    e = kg.edges if unknown else kg.edges.filter(p.rlike(PREDICATE))
    named = F.when(p.isNull(), UNKNOWN).when(p.rlike(PREDICATE), p).otherwise(F.lit("None")) if unknown else p
    x = ["x"] if extra is not None else []
    e = e.select("subject", named.alias("predicate"), "object", *([extra.alias("x")] if x else []))
    e = e.join(look.toDF("_s", "sc").hint("shuffle_hash"), F.col("subject") == F.col("_s")).groupBy("sc", "predicate", "object", *x).agg(F.count(F.lit(1)).alias("n"))
    return e.join(look.toDF("_o", "oc").hint("shuffle_hash"), F.col("object") == F.col("_o")).groupBy("sc", "predicate", "oc", *x).agg(F.sum("n").alias("n"))


def spread(groups: DataFrame) -> DataFrame:
    """Groups once for every (subject category, predicate, object category)."""
    return groups.withColumn("subject_category", F.explode("sc")).withColumn("object_category", F.explode("oc")).drop("sc", "oc")


TRIPLE = ("subject_category", "predicate", "object_category")


def triple_counts(kg: KG, unknown: bool = True) -> DataFrame:
    """``subject_category, predicate, object_category, n``."""
    return spread(grouped(kg, unknown)).groupBy(*TRIPLE).agg(F.sum("n").alias("n"))


def edge_facets(kg: KG, facet: str, unknown: bool = True) -> DataFrame:
    """``subject_category, predicate, object_category, value, n`` of one property."""
    return _facets(grouped(kg, unknown, facet_values(kg.edges, facet)))


def _facets(groups: DataFrame) -> DataFrame:
    """:func:`edge_facets` of edges that are grouped by the facet's values ``x``."""
    t = spread(groups)
    return t.select(*TRIPLE, F.explode("x").alias("value"), "n").groupBy(*TRIPLE, "value").agg(F.sum("n").alias("n"))


def meta_nodes(kg: KG) -> DataFrame:
    """``category, id_prefixes, n`` by the meta graph's rules."""
    rows = node_rows(first_nodes(kg), unknown=False)
    return rows.groupBy("category").agg(F.array_sort(F.collect_set(prefix_of("id"))).alias("id_prefixes"), F.count(F.lit(1)).alias("n"))


def meta_edges(kg: KG) -> DataFrame:
    """``subject_category, predicate, object_category, relations, n``."""
    return _relations(grouped(kg, False, as_list(kg.edges, "relation")))


def _relations(groups: DataFrame) -> DataFrame:
    """:func:`meta_edges` of edges that are grouped by their lists of relations ``x``."""
    every = F.array_compact(F.array_distinct(F.flatten(F.collect_set("x"))))
    return spread(groups).groupBy(*TRIPLE).agg(F.array_sort(every).alias("relations"), F.sum("n").alias("n"))


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """``id, n`` of ids with several records."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@dataclass(frozen=True)
class MetaGraph:
    """The meta graph's tables and the numbers read off them."""

    kg: KG
    node_facet: str = "provided_by"
    edge_facet: str = "knowledge_source"

    def nodes(self) -> DataFrame:
        return meta_nodes(self.kg)

    def edges(self) -> DataFrame:
        return meta_edges(self.kg)

    def totals(self) -> DataFrame:
        """One row: categories, nodes, nodes over categories, predicates, edges, triples,
        edges over triples."""
        n, m, g = first_nodes(self.kg), self.nodes(), stored(grouped(self.kg, unknown=False), "groups")
        e = spread(g).groupBy(*TRIPLE).agg(F.sum("n").alias("n"))
        a = n.agg(F.count(F.lit(1)).alias("nodes"))
        b = m.agg(F.count(F.lit(1)).alias("categories"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes_by_category"))
        c = e.agg(F.countDistinct("predicate").alias("predicates"), F.count(F.lit(1)).alias("triples"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges_by_triple"))
        return a.crossJoin(b).crossJoin(g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))).crossJoin(c)  # one row each

    def document(self) -> dict:
        """The meta graph as a document: its size is that of the model, not the data."""
        node_sources, edge_sources = {}, {}
        e = self.kg.edges
        both = F.struct(as_list(e, "relation").alias("r"), facet_values(e, self.edge_facet).alias("f"))
        groups = stored(grouped(self.kg, False, both), "groups")  # the edges are looked up once
        for r in node_facets(first_nodes(self.kg), self.node_facet, unknown=False).collect():
            node_sources.setdefault(r.category, {})[r.value] = r.n
        for r in _facets(groups.withColumn("x", F.col("x.f"))).collect():
            edge_sources.setdefault((r.subject_category, r.predicate, r.object_category), {})[r.value] = r.n
        nodes = {r.category: {"id_prefixes": list(r.id_prefixes), "count": r.n, "count_by_source": {self.node_facet: node_sources.get(r.category, {})}} for r in self.nodes().orderBy("category").collect()}
        edges = [
            {"subject": r.subject_category, "predicate": r.predicate, "object": r.object_category, "relations": list(r.relations), "count": r.n, "count_by_source": {self.edge_facet: edge_sources.get((r.subject_category, r.predicate, r.object_category), {})}}
            for r in _relations(groups.withColumn("x", F.col("x.r"))).orderBy(*TRIPLE).collect()
        ]
        return {"nodes": nodes, "edges": edges, "name": self.kg.name}


def graph_summary(kg: KG, node_facets_of: tuple[str, ...] = (), edge_facets_of: tuple[str, ...] = ()) -> dict:
    """The graph summary as a document; only aggregates reach the driver."""
    n = first_nodes(kg)
    rest = edge_facets_of[1:]
    groups = stored(grouped(kg, True, facet_values(kg.edges, edge_facets_of[0]) if edge_facets_of else None), "groups")  # the edges are looked up once for all but further facets
    cats = {r.category: {"count": r.n, "count_by_id_prefix": {}} for r in category_counts(n).collect()}
    for r in prefix_counts(n).collect():
        cats[r.category]["count_by_id_prefix"][r.prefix] = r.n
    for f in node_facets_of:
        for r in node_facets(n, f).collect():
            cats[r.category].setdefault(f, {})[r.value] = {"count": r.n}
    spo = {f"{r.subject_category}-{r.predicate}-{r.object_category}": {"count": r.n} for r in spread(groups).groupBy(*TRIPLE).agg(F.sum("n").alias("n")).collect()}
    for f in edge_facets_of:
        for r in (edge_facets(kg, f) if f in rest else _facets(groups)).collect():
            spo[f"{r.subject_category}-{r.predicate}-{r.object_category}"].setdefault(f, {})[r.value] = {"count": r.n}
    preds = {r.predicate: {"count": r.n} for r in predicate_counts(kg.edges).collect()}
    prefixes: dict[str, int] = {}
    for c in cats.values():
        for p, k in c["count_by_id_prefix"].items():
            prefixes[p] = prefixes.get(p, 0) + k
    known = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {
        "graph_name": kg.name,
        "node_stats": {"total_nodes": n.count(), "node_categories": sorted(cats), "node_id_prefixes": sorted(prefixes), "count_by_id_prefixes": prefixes, "count_by_category": cats},
        "edge_stats": {"total_edges": known, "predicates": sorted(preds), "count_by_predicates": preds, "count_by_spo": spo},
    }
