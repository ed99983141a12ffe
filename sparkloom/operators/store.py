"""Store semantics: upserts by key, implicit end points, lookups, removals, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import DEFAULT_CATEGORY
from ..kg import KG
from .normalize import col, edge_key, remade

EDGE = ("subject", "object", "edge_key")
TRIPLE = ("subject", "predicate", "object")


def keyed(edges: DataFrame) -> DataFrame:
    """Edges with their key."""
    return edges if "edge_key" in edges.columns else edges.withColumn("edge_key", edge_key())


def last_values(df: DataFrame, keys: tuple[str, ...], seq: str | Column) -> DataFrame:
    """One row a key: of every property the last value that is not null, in order of
    ``seq``; of values with equal ``seq`` the largest. A partial aggregation runs before the
    shuffle. Rows are sorted for it, by a hash of the keys, as texts of one prefix compare slowly."""
    order = F.col(seq) if isinstance(seq, str) else seq
    rest = [c for c in df.columns if c not in keys and c != seq]
    aggs = [F.max(F.when(col(c).isNotNull(), F.struct(order.alias("s"), col(c).alias("v")))).getField("v").alias(c) for c in rest]
    return df.groupBy(F.hash(*keys).alias("_hash"), *keys).agg(*aggs).drop("_hash") if aggs else df.select(*keys).distinct()


def first_records(df: DataFrame, keys: tuple[str, ...], seq: str, keep: bool = False) -> DataFrame:
    """The first whole record of every key; with ``keep``, its ``seq`` too."""
    rest = [c for c in df.columns if c not in keys and (keep or c != seq)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[col(c) for c in rest]), F.col(seq)).alias("r")).select(*keys, *[F.col("r").getField(c).alias(c) for c in rest])


def upsert(kg: KG, seq: str = "seq") -> KG:
    """Nodes by id and edges by (subject, object, key), the last value of each property.

    Both need a ``seq`` column that says in which order records came.
    """
    nodes = last_values(kg.nodes, ("id",), seq)
    if "edge_key" in kg.edges.columns and "edge_key" not in kg.made:
        return kg.with_(nodes=nodes, edges=last_values(kg.edges, EDGE, seq))
    made = (*(c for c in kg.made if c != "edge_key"), "edge_key")  # the ends and the predicate are the key
    return kg.with_(nodes=nodes, edges=remade(last_values(kg.edges.drop(*made), TRIPLE, seq), made), made=made)


def ends(edges: DataFrame) -> DataFrame:
    """``id`` of every end of every edge, repeated."""
    return edges.select(F.explode(F.array("subject", "object")).alias("id"))


def dangling(kg: KG) -> DataFrame:
    """``id`` of the edges' ends that are no node."""
    return ends(kg.edges).distinct().join(kg.nodes.select("id"), "id", "left_anti")


def with_endpoints(kg: KG, records: KG | None = None) -> KG:
    """Add the ends that are no node, with the default category. ``records`` are those that
    ``kg`` was upserted from: they have the same ends, without the work of upserting."""
    kind = kg.nodes.schema["category"].dataType.simpleString() if "category" in kg.nodes.columns else "array<string>"
    default = F.array(F.lit(DEFAULT_CATEGORY)) if kind.startswith("array") else F.lit(DEFAULT_CATEGORY)
    return kg.with_(nodes=kg.nodes.unionByName(dangling(records or kg).withColumn("category", default), allowMissingColumns=True))


def degrees(kg: KG) -> DataFrame:
    """``id, degree`` of every node; a self-loop counts twice, no edge is 0."""
    d = ends(kg.edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return kg.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def counts(kg: KG) -> tuple[int, int]:
    """Numbers of nodes and edges."""
    return kg.nodes.count(), kg.edges.count()


def node(kg: KG, id: str) -> DataFrame:
    return kg.nodes.filter(F.col("id") == id)


def edge(kg: KG, subject: str, object: str, key: str | None = None) -> DataFrame:
    e = kg.edges.filter((F.col("subject") == subject) & (F.col("object") == object))
    return e if key is None else keyed(e).filter(F.col("edge_key") == key)


def in_edges(kg: KG, id: str) -> DataFrame:
    return kg.edges.filter(F.col("object") == id)


def out_edges(kg: KG, id: str) -> DataFrame:
    return kg.edges.filter(F.col("subject") == id)


def remove_nodes(kg: KG, ids: DataFrame) -> KG:
    """Without the nodes ``id`` and the edges that touch them."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    edges = kg.edges.join(gone, F.col("subject") == F.col("_gone"), "left_anti").join(gone, F.col("object") == F.col("_gone"), "left_anti")
    return kg.with_(nodes=kg.nodes.join(gone, F.col("id") == F.col("_gone"), "left_anti"), edges=edges)


def remove_edges(kg: KG, which: DataFrame) -> KG:
    """Without the edges ``subject, object`` (and ``edge_key``, if given)."""
    on = [c for c in EDGE if c in which.columns]
    return kg.with_(edges=keyed(kg.edges).join(which.select(*on).distinct(), on, "left_anti"))


def set_attributes(df: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """Overwrite properties from a table of new values by key. Keys that are not there
    are ignored, nulls change nothing."""
    new = [c for c in values.columns if c not in keys]
    v = values.select(*keys, *[col(c).alias(f"_new_{c}") for c in new])
    out = df.join(v, keys, "left")
    for c in new:
        out = out.withColumn(c, F.coalesce(col(f"_new_{c}"), col(c)) if c in df.columns else col(f"_new_{c}"))
    return out.drop(*[f"_new_{c}" for c in new])


def attributes(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Key and value of the records that carry a property."""
    return df.filter(col(name).isNotNull()).select(*keys, col(name))


def relabel(kg: KG, mapping: DataFrame) -> KG:
    """Rename ids by ``old, new`` in nodes and edges; records that then collide merge,
    the last value of each property in order of their former ids."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    nodes = kg.nodes.join(m, F.col("id") == F.col("_old"), "left").withColumn("_seq", F.col("id")).withColumn("id", F.coalesce("_new", "id")).drop("_old", "_new")
    rest = [c for c in kg.edges.columns if c not in (*EDGE, "predicate")]
    edges = kg.edges.withColumn("_seq", edge_key()) if rest else kg.edges  # keys are long: none is shuffled that decides nothing
    for end in ("subject", "object"):
        edges = edges.join(m, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    edges = last_values(edges.drop("edge_key"), ("subject", "predicate", "object"), "_seq").withColumn("edge_key", edge_key())
    return kg.with_(nodes=last_values(nodes, ("id",), "_seq"), edges=edges)
