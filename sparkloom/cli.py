"""Command line: transform, merge, graph-summary, validate and database exchange."""

from __future__ import annotations

import argparse
import json
import sys

from .plans import transformer as t
from .session import build_session, ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)

    def reading(name: str, help: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=help)
        s.add_argument("inputs", nargs="*")
        s.add_argument("-i", "--input-format", default="tsv")
        s.add_argument("-c", "--input-compression")
        s.add_argument("-n", "--node-filter", action="append", nargs=2, default=[], metavar=("PROPERTY", "VALUE"))
        s.add_argument("-e", "--edge-filter", action="append", nargs=2, default=[], metavar=("PROPERTY", "VALUE"))
        s.add_argument("--stream", action="store_true")
        return s

    s = reading("graph-summary", "statistics of a graph")
    s.add_argument("-o", "--output")
    s.add_argument("-r", "--report-type", choices=("summary", "meta-knowledge-graph"), default="summary")
    s.add_argument("-f", "--report-format", choices=("json", "yaml"))
    s.add_argument("--node-facet", action="append", default=[])
    s.add_argument("--edge-facet", action="append", default=[])
    s = reading("validate", "check a graph against the model")
    s.add_argument("-o", "--output")
    s = reading("transform", "from one format to another")
    s.add_argument("-f", "--output-format", default="tsv")
    s.add_argument("-o", "--output")
    s.add_argument("-d", "--output-compression")
    s.add_argument("--transform-config")
    s = sub.add_parser("merge", help="merge graphs as a YAML file says")
    s.add_argument("--merge-config", required=True)
    for name in ("neo4j", "arangodb"):
        s = reading(f"{name}-upload", f"write a graph to {name}")
        s.add_argument("--uri")
        s.add_argument("--username", default="")
        s.add_argument("--password", default="")
        s.add_argument("-o", "--output")
        s = sub.add_parser(f"{name}-download", help=f"read a graph from {name}")
        for a in ("--uri", "--username", "--password"):
            s.add_argument(a, default="")
        s.add_argument("-f", "--output-format", default="tsv")
        s.add_argument("-o", "--output", required=True)
        s.add_argument("inputs", nargs="*")
    return p


def _filters(pairs: list[list[str]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        out.setdefault(k, set()).add(v)
    return out


def source(a: argparse.Namespace) -> dict:
    """Input arguments as a source description."""
    return {"format": a.input_format, "filename": a.inputs, "compression": a.input_compression, "node_filters": _filters(a.node_filter), "edge_filters": _filters(a.edge_filter)}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = ship(build_session(master=a.master))
    if a.command == "merge":
        t.run_merge(spark, a.merge_config)
    elif a.command == "transform" and a.transform_config:
        t.run_transform(spark, a.transform_config)
    elif a.command == "transform":
        t.transform(spark, source(a), {"format": a.output_format, "filename": a.output, "compression": a.output_compression}, stream=a.stream)
    elif a.command == "graph-summary":
        kg = t.load(spark, source(a))
        kind = "summary" if a.report_type == "summary" else a.report_type
        facets = {"node_facets": tuple(a.node_facet), "edge_facets": tuple(a.edge_facet)}
        if a.output:
            t.write_summary(kg, a.output, kind, a.report_format, **facets)
        else:
            json.dump(t.graph_report(kg, kind, **facets), sys.stdout, indent=2)
    elif a.command == "validate":
        found = t.validation(t.load(spark, source(a)), a.output)
        return int(found.filter("level = 'ERROR'").limit(1).count() > 0)
    elif a.command == "neo4j-upload":
        t.transform(spark, source(a), {"format": "neo4j", "uri": a.uri, "username": a.username, "password": a.password})
    elif a.command == "arangodb-upload":
        t.transform(spark, source(a), {"format": "arangodb", "filename": a.output})
    elif a.command == "neo4j-download":
        t.transform(spark, {"format": "neo4j", "uri": a.uri, "username": a.username, "password": a.password}, {"format": a.output_format, "filename": a.output})
    elif a.command == "arangodb-download":
        from .sources.databases import load_arango

        t.save(spark, load_arango(spark.read.json(a.inputs[0]), spark.read.json(a.inputs[1])), {"format": a.output_format, "filename": a.output})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
