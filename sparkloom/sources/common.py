"""What all readers share: the record pipeline from raw rows to a graph."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kg import KG
from ..operators.filters import Filters
from ..operators.normalize import remade, sanitize_import, undeclared_lists, valid_edges, valid_nodes, with_edge_ids
from ..operators.provenance import Provenance


@dataclass(frozen=True)
class ReadOptions:
    """``delimiter``: of list values (None: lists are typed already); ``provenance``:
    options by column; ``source``: default source name; ``stable_ids``: new edge ids
    depend on the edge alone."""

    delimiter: str | None = "|"
    provenance: dict = field(default_factory=dict, hash=False)
    source: str = "graph"
    filters: Filters | None = field(default=None, hash=False)
    stable_ids: bool = True


def with_seq(df: DataFrame, rank: int = 0) -> DataFrame:
    """Number the records in reading order, before anything moves them: by file rank,
    then split and row within it."""
    return df.withColumn("seq", F.monotonically_increasing_id() + F.lit(rank).cast("long") * (1 << 58))


def finish(nodes: DataFrame | None, edges: DataFrame | None, o: ReadOptions, name: str, spark, listed: dict[str, DataFrame] | None = None) -> KG:
    """Validate, type, add provenance, filter and identify raw records.

    Stable ids and keys are made of the cleaned ends of the edges that are left, last, so
    that no join moves them; where a filter asks for them they are made first. ``listed``
    has, by role, all the raw records that hold the delimiter, where a reader finds these
    at less cost than that of typing every record."""
    prov = Provenance.of(o.provenance, o.source)
    if nodes is None:
        nodes = spark.createDataFrame([], "id string, category array<string>, seq long")
    if edges is None:
        edges = spark.createDataFrame([], "subject string, predicate string, object string, seq long")
    named = lambda n: valid_nodes(n.filter("id is not null") if "id" in n.columns else n.limit(0).selectExpr("cast(null as string) as id", "*"))
    few = lambda role, valid: undeclared_lists(valid(listed[role]), o.delimiter) if listed and role in listed else None
    nodes = prov.nodes(sanitize_import(named(nodes), o.delimiter, few("nodes", named)))
    raw, text = valid_edges(edges), lambda d: all(isinstance(d.schema[c].dataType, T.StringType) for c in ("subject", "predicate", "object"))
    made = ("edge_key", "id") if o.stable_ids and "id" not in raw.columns else ("edge_key",)
    edges = sanitize_import(raw if "id" in made else with_edge_ids(raw, o.stable_ids), o.delimiter, few("edges", valid_edges))
    if "id" in made and not text(edges):
        edges, made = sanitize_import(with_edge_ids(raw, True), o.delimiter), ("edge_key",)
    edges = prov.edges(edges)
    nodes, edges = (d.withColumn("seq", F.col("seq").cast("long")) for d in (nodes, edges))
    if o.filters and not {"id", "edge_key"}.isdisjoint(o.filters.edges):
        edges = remade(edges, made)
    kg = KG(nodes, edges, name)
    kg = o.filters.apply(kg) if o.filters else kg
    return kg.with_(edges=remade(kg.edges, made), made=made if text(edges) else ())


def role(path: str, fmt: str) -> str | None:
    """``nodes`` or ``edges`` by the file's name, None for any other."""
    name = PurePosixPath(path).name
    for ending in (".gz", ".bz2"):
        name = name.removesuffix(ending)
    for r in ("nodes", "edges"):
        if name.endswith(f"{r}.{fmt}"):
            return r
    return None
