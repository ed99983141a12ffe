"""Operations that move information between identifiers, properties and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import EDGE_CORE, NODE_CORE
from ..kg import KG
from .normalize import col, edge_key
from .store import ends, relabel, with_endpoints


def _has_category(nodes: DataFrame, category: str) -> Column:
    if "category" not in nodes.columns:
        return F.lit(True)
    c = F.col("category")
    if isinstance(nodes.schema["category"].dataType, T.ArrayType):
        return c.isNull() | (F.size(c) == 0) | F.array_contains(c, category)
    return c.isNull() | (c == category)


def remap_identifiers(kg: KG, category: str, alternative: str, prefix: str | None = None) -> KG:
    """Replace the ids of a category's nodes (and of nodes without one) by another of
    their identifiers, in nodes and edges.

    From a list: the first member that contains the prefix, or the first member. From a
    string: itself if it starts with the prefix. Nodes without such a value keep theirs.
    """
    c = col(alternative)
    if isinstance(kg.nodes.schema[alternative].dataType, T.ArrayType):
        fit = F.filter(c, lambda x: x.contains(prefix)) if prefix else c
        new = F.when(F.size(fit) > 0, F.element_at(fit, 1))
    else:
        new = F.when(c.startswith(prefix), c) if prefix else c
    mapping = kg.nodes.filter(_has_category(kg.nodes, category)).select(F.col("id").alias("old"), new.alias("new")).filter("new is not null")
    return relabel(kg, mapping)


def remap_node_property(kg: KG, category: str | None, old: str, new: str) -> KG:
    """Overwrite a node property by another where that has a value; ``category`` None
    means all nodes. Core properties cannot be overwritten."""
    if old in NODE_CORE:
        raise ValueError(f"core property {old!r} cannot be remapped")
    cond = F.lit(True) if category is None else _has_category(kg.nodes, category)
    value = F.when(cond & col(new).isNotNull(), col(new)).otherwise(col(old) if old in kg.nodes.columns else F.lit(None))
    return kg.with_(nodes=kg.nodes.withColumn(old, value))


def remap_edge_property(kg: KG, predicate: str, old: str, new: str) -> KG:
    """Overwrite an edge property by another on the edges of a predicate."""
    if old in EDGE_CORE:
        raise ValueError(f"core property {old!r} cannot be remapped")
    value = F.when((F.col("predicate") == predicate) & col(new).isNotNull(), col(new)).otherwise(col(old) if old in kg.edges.columns else F.lit(None))
    return kg.with_(edges=kg.edges.withColumn(old, value))


def fold_predicate(kg: KG, predicate: str, remove_prefix: bool = False, seq: str | None = None) -> KG:
    """Turn the edges of a predicate into a property of their subjects.

    Of several edges the first by ``seq`` (by object where there is none) gives the
    value. The edges go, their objects stay.
    """
    prop = predicate.split(":")[-1] if remove_prefix else predicate
    hit = F.col("predicate") == predicate
    order = F.col(seq) if seq else F.col("object")
    v = kg.edges.filter(hit).groupBy("subject").agg(F.min(F.struct(order.alias("o"), F.col("object").alias("v"))).getField("v").alias("_value"))
    nodes = kg.nodes.join(v, F.col("id") == F.col("subject"), "left").drop("subject")
    nodes = nodes.withColumn(prop, F.coalesce("_value", col(prop)) if prop in kg.nodes.columns else F.col("_value")).drop("_value")
    return kg.with_(nodes=nodes, edges=kg.edges.filter(~hit | F.col("predicate").isNull()))


def unfold_property(kg: KG, name: str, prefix: str | None = None) -> KG:
    """Turn a node property into edges to its values, each value of a list; new objects
    become nodes and the property goes."""
    many = isinstance(kg.nodes.schema[name].dataType, T.ArrayType)
    pred = F.lit(f"{prefix}:{name}" if prefix else name)
    new = kg.nodes.filter(col(name).isNotNull()).select(F.col("id").alias("subject"), pred.alias("predicate"), (F.explode(col(name)) if many else col(name)).alias("object"), pred.alias("relation"))
    if "edge_key" in kg.edges.columns:
        new = new.withColumn("edge_key", edge_key())
    return with_endpoints(kg.with_(nodes=kg.nodes.drop(name), edges=kg.edges.unionByName(new, allowMissingColumns=True)))


def remove_singletons(kg: KG) -> KG:
    """Without the nodes that no edge touches."""
    touched = ends(kg.edges).distinct()  # else all edges of a hub meet in one task
    return kg.with_(nodes=kg.nodes.join(touched, "id", "left_semi"))
