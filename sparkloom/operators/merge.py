"""Merging graphs: records of one key are folded in priority order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import EDGE_CORE, MULTIVALUED, NODE_CORE
from ..kg import KG
from ..session import stored
from .normalize import col, remade
from .store import EDGE, TRIPLE, keyed


def _ordered(name: str) -> Column:
    """The key's values of a property, first record first, nulls left out."""
    held = F.array_sort(F.collect_list(F.when(col(name).isNotNull(), F.struct("_rank", "_seq", col(name).alias("v")))))
    return F.transform(held, lambda s: s["v"])


def _together(parts: list[DataFrame], keys: tuple[str, ...]) -> tuple[DataFrame, dict[str, T.DataType], list[str]]:
    """All records with their part's number ``_rank`` and ``_seq``; a property is a list in
    all parts if it is in any. Besides, the types and names of the properties."""
    ranked = [p.withColumn("_rank", F.lit(i)).withColumn("_seq", F.col("seq") if "seq" in p.columns else F.lit(0)).drop("seq") for i, p in enumerate(parts)]
    types: dict[str, T.DataType] = {}
    for p in ranked:
        for f in p.schema.fields:
            if not isinstance(types.get(f.name), T.ArrayType):
                types[f.name] = f.dataType
    def lifted(p: DataFrame) -> DataFrame:
        for f in p.schema.fields:
            if isinstance(types[f.name], T.ArrayType) and not isinstance(f.dataType, T.ArrayType):
                p = p.withColumn(f.name, F.when(col(f.name).isNotNull(), F.array(col(f.name).cast("string"))))
        return p
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(lifted, ranked))
    return every, types, [c for c in every.columns if c not in keys and c not in ("_rank", "_seq")]


def merge_records(parts: list[DataFrame], keys: tuple[str, ...], core: tuple[str, ...], preserve: bool) -> DataFrame:
    """One row a key from records in priority order.

    Several-valued properties take the distinct values of all in order. Core properties
    keep the first value. Others take the last value, or with ``preserve`` all values:
    such a property is a list for the whole result if any key has two values for it.
    """
    every, types, rest = _together(parts, keys)
    grouped = every.groupBy(F.hash(*keys).alias("_hash"), *keys).agg(*[_ordered(c).alias(c) for c in rest]).drop("_hash")  # sorted by a hash: texts of one prefix compare slowly
    return _merged(grouped, keys, core, preserve, types, keep=True)


def _merged(grouped: DataFrame, keys: tuple[str, ...], core: tuple[str, ...], preserve: bool, types: dict[str, T.DataType], keep: bool = False) -> DataFrame:
    """The result from rows of a key and the ordered values of each property; with ``keep``
    the rows are stored where they are read twice."""
    rest = [c for c in grouped.columns if c not in keys]
    conflict = [c for c in rest if preserve and c not in core and not MULTIVALUED.get(c, False) and not isinstance(types[c], T.ArrayType)]
    grouped = stored(grouped, "merged") if keep and conflict else grouped
    several = grouped.agg(*[F.coalesce(F.bool_or(F.size(col(c)) > 1), F.lit(False)).alias(c) for c in conflict]).first() if conflict else ()
    lists = {c for c, v in zip(conflict, several) if v}
    out = []
    for c in rest:
        v, many = col(c), isinstance(types[c], T.ArrayType)
        if c in core:
            new = F.try_element_at(v, F.lit(1))
        elif MULTIVALUED.get(c, False):
            new = F.array_distinct(F.flatten(v)) if many else F.array_distinct(v)
        elif many:
            new = F.flatten(v) if preserve or c in MULTIVALUED else F.array_distinct(F.flatten(v))
        elif c in lists:
            new = v
        else:
            new = F.try_element_at(v, F.lit(-1))
        out.append((F.when(F.size(v) > 0, new) if many or MULTIVALUED.get(c, False) or c in lists else new).alias(c))
    return grouped.select(*keys, *out)


def merge(graphs: list[KG], preserve: bool = True, target_first: bool = True) -> KG:
    """Keyed union of graphs into the first one: nodes by id, edges by (subject, object,
    key). With ``target_first`` False, the graph of most edges (the first of equals) is
    made the target, which counts the edges of each."""
    if not graphs:
        raise ValueError("no graphs to merge")
    if not target_first:
        n = [g.edges.count() for g in graphs]
        big = n.index(max(n))
        graphs = [graphs[big], *graphs[:big], *graphs[big + 1 :]]
    nodes = merge_records([g.nodes for g in graphs], ("id",), NODE_CORE, preserve)
    made = tuple(c for c in ("edge_key", "id") if all(c in g.made for g in graphs))
    if "edge_key" not in made:
        return KG(nodes, merge_records([keyed(g.edges) for g in graphs], EDGE, EDGE_CORE, preserve), graphs[0].name)
    edges = merge_records([g.edges.drop(*made) for g in graphs], TRIPLE, EDGE_CORE, preserve)
    return KG(nodes, remade(edges, made), graphs[0].name, made)


def folded(parts: list[DataFrame], keys: tuple[str, ...]) -> tuple[DataFrame, dict[str, T.DataType], list[str]]:
    """A row a key with the last value of each property ``c`` in each part ``i`` (column
    ``i c``, by ``_seq``) and whether the part has the key (``i``), stored."""
    every, types, rest = _together(parts, keys)
    here = lambda i: F.col("_rank") == i
    last = lambda i, c: F.max(F.when(here(i) & col(c).isNotNull(), F.struct("_seq", col(c).alias("v")))).getField("v").alias(f"{i} {c}")
    aggs = [a for i, p in enumerate(parts) for a in (F.max(here(i)).alias(str(i)), *(last(i, c) for c in rest if c in p.columns))]
    return stored(every.groupBy(F.hash(*keys).alias("_hash"), *keys).agg(*aggs).drop("_hash"), "folded"), types, rest


def merge_unfolded(graphs: list[KG], preserve: bool = True) -> KG:
    """:func:`merge_all` of the graphs' upserts, in one grouping of all records, not one for
    the upserts and one for the merge. Edges' keys must follow from their ends."""
    made = tuple(c for c in ("edge_key", "id") if all(c in g.made for g in graphs))
    if "edge_key" not in made:
        raise ValueError("keys of edges that do not follow from their ends")
    parts = {"edges": [g.edges.drop(*made) for g in graphs], "nodes": [g.nodes for g in graphs]}
    order, out = [], {}
    for what, keys, core in (("edges", TRIPLE, EDGE_CORE), ("nodes", ("id",), NODE_CORE)):
        rows, types, rest = folded(parts[what], keys)
        if not order:
            n = rows.agg(*[F.coalesce(F.sum(col(str(i)).cast("long")), F.lit(0)).alias(str(i)) for i in range(len(graphs))]).first()
            big = max(range(len(graphs)), key=lambda i: n[i])  # the first of equals
            order = [big, *(i for i in range(len(graphs)) if i != big)]
        held = lambda c: F.filter(F.array(*[col(f"{i} {c}") for i in order if f"{i} {c}" in rows.columns]), lambda v: v.isNotNull())  # noqa: B023, E731 - used at once
        out[what] = _merged(rows.select(*keys, *[held(c).alias(c) for c in rest]), keys, core, preserve, types)
    return KG(out["nodes"], remade(out["edges"], made), graphs[order[0]].name, made)


def merge_all(graphs: list[KG], preserve: bool = True) -> KG:
    """:func:`merge` into the graph of most edges."""
    return merge(graphs, preserve, target_first=False)
