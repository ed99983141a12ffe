"""Transforms described by dictionaries or YAML: read, operate, inspect, write, merge."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from inspect import signature
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..kg import KG
from ..operators import clique, filters, merge, reshape, store, summary, validate
from ..operators.filters import Filters
from ..operators.normalize import remade
from ..operators.report import write_report
from ..sinks import databases as db_sinks
from ..sinks import files
from ..sources import databases, delimited, jsons, rdf, sssom
from ..session import stored as kept
from ..sources.common import ReadOptions

Operation = Callable[..., KG]
#: Operations by name; programs may add their own.
OPERATIONS: dict[str, Operation] = {
    "remap_node_identifier": lambda g, category, alternative_property, prefix=None: reshape.remap_identifiers(g, category, alternative_property, prefix),
    "remap_node_property": lambda g, category, old_property, new_property: reshape.remap_node_property(g, category, old_property, new_property),
    "remap_edge_property": lambda g, edge_predicate, old_property, new_property: reshape.remap_edge_property(g, edge_predicate, old_property, new_property),
    "fold_predicate": lambda g, predicate, remove_prefix=False: reshape.fold_predicate(g, predicate, remove_prefix),
    "unfold_node_property": lambda g, node_property, prefix=None: reshape.unfold_property(g, node_property, prefix),
    "remove_singleton_nodes": lambda g: reshape.remove_singletons(g),
    "clique_merge": lambda g, leader_annotation="clique_leader", prefix_prioritization_map=None, category_mapping=None, strict=True: clique.clique_merge(g, leader_annotation, None, prefix_prioritization_map, strict, category_mapping),
    "apply_filters": lambda g, node_filters=None, edge_filters=None: _store_filters(g, node_filters or {}, edge_filters or {}),
}


def _store_filters(g: KG, nodes: dict, edges: dict) -> KG:
    if "category" in nodes:
        g = filters.filter_nodes(g, set(nodes["category"]))
    return filters.filter_edges(g, {k: list(v) if not isinstance(v, str) else [v] for k, v in edges.items()})


def _sets(spec: dict | None) -> dict:
    """Filter lists from YAML as sets."""
    return {k: set(v) if isinstance(v, (list, tuple)) else v for k, v in (spec or {}).items()}


#: Readers ``(spark, source) -> KG`` and writers ``(kg, target) -> Any`` of formats that
#: programs add, by name; they go before the built-in ones.
SOURCES: dict[str, Callable[[SparkSession, dict[str, Any]], KG]] = {}
SINKS: dict[str, Callable[[KG, dict[str, Any]], Any]] = {}


def load(spark: SparkSession, source: dict[str, Any]) -> KG:
    """A graph from ``{format, filename, ...}``; many files are one graph.

    Keys besides: ``compression, node_filters, edge_filters, name``, provenance options,
    and the format's own.
    """
    s = dict(source)
    fmt, name = s["format"], s.get("name", "graph")
    if fmt in SOURCES:
        return Filters.of(_sets(s.get("node_filters")), _sets(s.get("edge_filters"))).apply(SOURCES[fmt](spark, s))
    paths = s.get("filename", [])
    paths = [paths] if isinstance(paths, str) else list(paths)
    f = Filters.of(_sets(s.get("node_filters")), _sets(s.get("edge_filters")))
    default = s.get("source") or (PurePosixPath(paths[0]).name if paths else "graph")
    o = ReadOptions("|" if fmt in ("tsv", "csv", "sssom", "nt") else None, s.get("provenance", {k: v for k, v in s.items() if k.endswith("_source") or k == "provided_by"}), default, f)
    if fmt in ("tsv", "csv"):
        return delimited.load(spark, paths, fmt, s.get("compression"), o, name)
    if fmt == "jsonl":
        return jsons.load_jsonl(spark, paths, o, name)
    one: dict[str, Callable[[str], KG]] = {
        "json": lambda p: jsons.load_json(spark, p, o, name),
        "obojson": lambda p: jsons.load_obograph(spark, p, o, name),
        "obo-json": lambda p: jsons.load_obograph(spark, p, o, name),
        "trapi-json": lambda p: jsons.load_trapi(spark, p, o, name),
        "sssom": lambda p: sssom.load(spark, p, o, name),
        "nt": lambda p: rdf.load_ntriples(spark, p, o, name, names=s.get("predicate_mappings"), node_properties=tuple(s.get("property_types", ()))),
        "owl": lambda p: rdf.load_owl(spark, p, o, name, tuple(s.get("imports", ()))),
        "duckdb": lambda p: databases.load_duckdb(spark, p, f, s.get("start"), s.get("end"), name=name),
    }
    if fmt in one:
        return concatenated([one[fmt](p) for p in paths], name)
    if fmt == "parquet":
        return f.apply(databases.load_parquet(spark, s["nodes"] if "nodes" in s else paths[0], s["edges"] if "edges" in s else paths[1], name=name))
    if fmt == "neo4j":
        return databases.load_neo4j(spark, s["uri"], s["username"], s["password"], f, s.get("is_directed", True), o, name)
    if fmt == "arangodb":  # exported documents, as JSON Lines
        return f.apply(databases.load_arango(*[spark.read.json(p) for p in paths[:2]], o, name))
    if fmt == "graph":
        return f.apply(s["graph"])
    raise ValueError(f"unknown input format {fmt!r}")


def concatenated(graphs: list[KG], name: str) -> KG:
    """All records of several graphs, without merging."""
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    made = tuple(c for c in graphs[0].made if all(c in g.made for g in graphs))
    return KG(reduce(union, [g.nodes for g in graphs]), reduce(union, [g.edges for g in graphs]), name, made)


def stored(kg: KG, gated: bool = False) -> KG:
    """Records as a graph store holds them: upserted, with the missing ends. There are none
    of a graph whose edges are gated by their ends."""
    return store.upsert(kg) if gated else store.with_endpoints(store.upsert(kg), kg)


def _gated(source: dict[str, Any]) -> bool:
    """Whether the filters of a source leave no edge without its ends."""
    whole = source["format"] not in ("graph", *SOURCES) and source.get("start") is None and source.get("end") is None
    return whole and "category" in (source.get("node_filters") or {})


def operate(kg: KG, operations: list[dict]) -> KG:
    """Named operations in order, each ``{name, args}``."""
    for op in operations or []:
        name = op["name"].rsplit(".", 1)[-1]
        if name not in OPERATIONS:
            raise ValueError(f"unknown operation {name!r}; known: {', '.join(sorted(OPERATIONS))}")
        args, takes = op.get("args") or {}, list(signature(OPERATIONS[name]).parameters)[1:]
        if wrong := set(args) - set(takes):
            raise ValueError(f"{name!r} has no argument {', '.join(map(repr, sorted(wrong)))}; it takes: {', '.join(takes)}")
        kg = OPERATIONS[name](kg, **args)
    return kg


def save(spark: SparkSession, kg: KG, target: dict[str, Any]) -> Any:
    """Write to ``{format, filename, ...}``."""
    fmt, path = target["format"], target.get("filename")
    if fmt in SINKS:
        return SINKS[fmt](kg, target)
    np, ep = target.get("node_properties"), target.get("edge_properties")
    if fmt in ("tsv", "csv"):
        c = target.get("compression")
        if c and c.startswith("tar"):
            return files.write_archive(spark, kg, path, fmt, c.partition(".")[2].replace("bz2", "bz2"))
        return files.write_delimited(kg, path, fmt, node_properties=np, edge_properties=ep, compression=c)
    if fmt == "json":
        return files.write_json(spark, kg, path)
    if fmt == "jsonl":
        return files.write_jsonl(kg, path, target.get("compression"), np, ep, target.get("rows_a_file", 0))
    if fmt == "parquet":
        return files.write_parquet(kg, path)
    if fmt == "nt":
        return files.write_ntriples(kg, path, target.get("reify_all_edges", False), target.get("compression"))
    if fmt == "trapi-json":
        return files.write_trapi(spark, kg, path, target.get("knowledge_source"))
    if fmt == "sql":
        return db_sinks.write_sqlite(kg, path, target.get("node_table_name", "nodes"), target.get("edge_table_name", "edges"))
    if fmt == "neo4j":
        return db_sinks.write_neo4j(kg, target["uri"], target["username"], target["password"])
    if fmt == "arangodb":
        return db_sinks.write_arango(kg, path, target.get("curie_routing", True))
    if fmt == "null":
        return files.write_null(kg)
    raise ValueError(f"unknown output format {fmt!r}")


def transform(spark: SparkSession, source: dict, target: dict | None = None, operations: list[dict] | None = None, stream: bool = False, inspector: Callable[[KG], None] | None = None) -> KG:
    """Read, operate and write. With ``stream`` records pass as they are: no upsert, no
    implicit nodes, no operations. The inspector sees the graph before it is written."""
    kg = load(spark, source)
    if not stream:
        kg = operate(stored(kg, _gated(source)), [*(source.get("operations") or []), *(operations or [])])
    if inspector:
        inspector(kg)
    if target:
        save(spark, kg, target)
    return kg


def _yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def _source(config: dict) -> dict:
    out = dict(config.get("input") or {})
    out.update({k: config[k] for k in ("name", "operations", "filters") if k in config})
    for k, v in (out.pop("filters", None) or {}).items():
        out[k] = v
    return out


def run_transform(spark: SparkSession, config: dict | str) -> dict[str, KG]:
    """Every source of a transform configuration, each to its own output."""
    c = _yaml(config) if isinstance(config, str) else config
    out = {}
    for name, s in (c.get("transform", c).get("source") or {}).items():
        out[name] = transform(spark, {"name": name, **_source(s)}, s.get("output"), stream=c.get("configuration", {}).get("stream", False))
    return out


FOLDED = 8


def run_merge(spark: SparkSession, config: dict | str) -> KG:
    """The sources of a merge configuration, merged, operated on and written to every
    destination. Records of up to ``FOLDED`` sources without operations are upserted and
    merged at once. Otherwise each source's graph is kept in the shared folder, since it is
    read several times; ``checkpoint`` asks for a checkpoint instead."""
    c = _yaml(config) if isinstance(config, str) else config
    m, conf = c.get("merged_graph", c), c.get("configuration", {})
    sources = [{"name": name, **_source(s)} for name, s in (m.get("source") or {}).items()]
    kg = None
    if 0 < len(sources) <= FOLDED and not conf.get("checkpoint") and not any(s.get("operations") for s in sources):
        loaded = [load(spark, s) for s in sources]
        if all("edge_key" in g.made and {"seq"} <= set(g.nodes.columns) & set(g.edges.columns) for g in loaded):
            kg = merge.merge_unfolded([g if _gated(s) else store.with_endpoints(g) for g, s in zip(loaded, sources)], conf.get("preserve", True))
    kg = operate(replace(kg or _merged(spark, sources, conf), name=m.get("name", "merged")), m.get("operations") or [])
    for d in (m.get("destination") or {}).values():
        save(spark, kg, d)
    return kg


def _merged(spark: SparkSession, sources: list[dict[str, Any]], conf: dict[str, Any]) -> KG:
    """The merge of sources that are upserted, and operated on, each for itself."""
    graphs = []
    for s in sources:
        g = transform(spark, s)
        if conf.get("checkpoint"):
            graphs.append(g.checkpoint())
        else:
            edges = remade(kept(g.edges.drop(*g.made), "merge"), g.made)
            graphs.append(g.with_(nodes=kept(g.nodes, "merge"), edges=edges, made=g.made))
    return merge.merge_all(graphs, conf.get("preserve", True))


def graph_report(kg: KG, kind: str = "summary", node_facets: tuple[str, ...] = (), edge_facets: tuple[str, ...] = ()) -> dict:
    """The graph summary or the meta graph as a document."""
    if kind in ("meta", "meta-knowledge-graph"):
        return summary.MetaGraph(kg, (node_facets or ("provided_by",))[0], (edge_facets or ("knowledge_source",))[0]).document()
    return summary.graph_summary(kg, node_facets, edge_facets)


def write_summary(kg: KG, path: str, kind: str = "summary", fmt: str | None = None, **facets) -> str:
    """A report as JSON or YAML (the summary's default)."""
    doc = graph_report(kg, kind, **facets)
    with open(path, "w") as f:
        if (fmt or ("json" if kind != "summary" else "yaml")) == "json":
            json.dump(doc, f, indent=2)
        else:
            import yaml

            yaml.safe_dump(doc, f, sort_keys=False)
    return path


def validation(kg: KG, path: str | None = None, level: str | None = None) -> DataFrame:
    """Findings on a graph, and their report in a file if one is named."""
    found = validate.validate(kg)
    if path:
        with open(path, "w") as f:
            write_report(found, f, level)
    return found
