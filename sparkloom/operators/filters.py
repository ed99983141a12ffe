"""Node and edge filters, and what they imply for each other."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.curie import all_of, any_of
from ..kg import KG
from .normalize import col

ENDPOINTS = ("subject_category", "object_category")


def predicate(df: DataFrame, spec: dict[str, str | Collection[str]], skip: tuple[str, ...] = ()) -> Column:
    """AND over the properties of a filter.

    A collection asks for any of its values: a member of a list, but a *substring* of a
    string. A string asks for equality. A property that is absent or null fails.
    """
    tests = []
    for key, want in spec.items():
        if key in skip:
            continue
        if key not in df.columns:
            return F.lit(False)
        c, many = col(key), isinstance(df.schema[key].dataType, T.ArrayType)
        if isinstance(want, str):
            test = F.concat_ws("\u0001", c) == want if many else c.cast("string") == want
        elif isinstance(want, Collection):
            values = sorted(map(str, want))
            test = F.arrays_overlap(c, F.array(*map(F.lit, values))) if many else any_of([c.cast("string").contains(v) for v in values])
        else:
            raise TypeError(f"filter on {key!r}: expected a string or a collection, got {type(want).__name__}")
        tests.append(F.coalesce(test, F.lit(False)))
    return all_of(tests)


@dataclass(frozen=True)
class Filters:
    """Filters with their implications: a node category filter also holds for both ends
    of an edge; an edge's end category filter also admits nodes of that category."""

    nodes: dict = field(default_factory=dict)
    edges: dict = field(default_factory=dict)

    @staticmethod
    def of(nodes: dict | None = None, edges: dict | None = None) -> Filters:
        n, e = {}, {}
        for key, value in (nodes or {}).items():
            if key == "category":
                if not isinstance(value, (set, frozenset)):
                    raise TypeError("a filter on category takes a set")
                n[key] = set(n.get(key, set())) | set(value)
                for end in ENDPOINTS:
                    e[end] = set(e.get(end, set())) | set(value)
            else:
                n[key] = value
        for key, value in (edges or {}).items():
            if key in ENDPOINTS:
                if not isinstance(value, (set, frozenset)):
                    raise TypeError(f"a filter on {key} takes a set")
                e[key] = set(e.get(key, set())) | set(value)
                n["category"] = set(n.get("category", set())) | set(value)
            else:
                e[key] = value
        return Filters(n, e)

    def apply(self, kg: KG) -> KG:
        """Filtered nodes, and the edges whose filtered ends are among them: the ends are
        gated by semi-joins on the nodes' ids."""
        nodes = kg.nodes.filter(predicate(kg.nodes, self.nodes))
        edges = kg.edges.filter(predicate(kg.edges, self.edges, skip=ENDPOINTS))
        return kg.with_(nodes=nodes, edges=gate(edges, nodes, "subject_category" in self.edges, "object_category" in self.edges), made=kg.made)


KINDS = 1024


def _kind(name: str) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(name, ":", 1)), F.lit(KINDS))


def gate(edges: DataFrame, nodes: DataFrame, subject: bool, object: bool) -> DataFrame:
    """Edges whose subject and/or object is one of the nodes.

    Ends of a prefix that no node has are left out before edges are moved: prefixes are
    held as at most ``KINDS`` hashes, so that their table is bounded."""
    ends = [end for wanted, end in ((subject, "subject"), (object, "object")) if wanted]
    if ends and not nodes.isStreaming:
        kinds = F.broadcast(nodes.select(_kind("id").alias("_kind")).distinct())
        for end in ends:
            edges = edges.join(kinds, _kind(end) == F.col("_kind"), "left_semi")
    ids = nodes.select(F.col("id").alias("_end"))
    for end in ends:
        edges = edges.join(ids, F.col(end) == F.col("_end"), "left_semi")
    return edges


def filter_nodes(kg: KG, categories: set[str]) -> KG:
    """Store filter: nodes of the categories, and the edges between them."""
    nodes = kg.nodes.filter(predicate(kg.nodes, {"category": categories}))
    return kg.with_(nodes=nodes, edges=gate(kg.edges, nodes, True, True), made=kg.made)


def filter_edges(kg: KG, spec: dict[str, Collection[str]]) -> KG:
    """Store filter: edges whose predicate and relation are among those given."""
    edges = kg.edges
    for key in ("predicate", "relation"):
        if key in spec:
            edges = edges.filter(col(key).isin(list(spec[key]))) if key in edges.columns else edges.limit(0)
    return kg.with_(edges=edges)


def sql_where(spec: dict[str, str | Collection[str]], many: Collection[str] = ("category", "provided_by")) -> str:
    """A SQL predicate for a database scan, quoted; empty for no filter."""
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    name = lambda k: '"' + k.replace('"', '""') + '"'
    tests = []
    for k, v in spec.items():
        values = [v] if isinstance(v, str) else sorted(v)
        if k in many:
            tests.append(f"list_has_any({name(k)}, [{', '.join(map(quote, values))}])")
        else:
            tests.append(f"{name(k)} IN ({', '.join(map(quote, values))})")
    return " AND ".join(tests)
