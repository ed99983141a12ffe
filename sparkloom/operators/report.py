"""The error model: kinds and levels of findings, and their roll-up."""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("INFO", "WARNING", "ERROR")
KINDS = tuple(
    "MISSING_NODE_PROPERTY MISSING_EDGE_PROPERTY INVALID_NODE_PROPERTY INVALID_EDGE_PROPERTY INVALID_NODE_PROPERTY_VALUE_TYPE "
    "INVALID_NODE_PROPERTY_VALUE INVALID_EDGE_PROPERTY_VALUE_TYPE INVALID_EDGE_PROPERTY_VALUE NO_CATEGORY MISSING_CATEGORY INVALID_CATEGORY "
    "MISSING_EDGE_PREDICATE INVALID_EDGE_PREDICATE MISSING_NODE_CURIE_PREFIX DUPLICATE_NODE MISSING_NODE INVALID_EDGE_TRIPLE VALIDATION_SYSTEM_ERROR".split()
)
SCHEMA = "entity string, level string, kind string, message string"


def finding(entity: Column, kind: str, message: Column | str, level: str = "ERROR") -> list[Column]:
    """The columns of a finding."""
    return [entity.alias("entity"), F.lit(level).alias("level"), F.lit(kind).alias("kind"), (F.lit(message) if isinstance(message, str) else message).alias("message")]


def roll_up(findings: DataFrame) -> DataFrame:
    """``level, kind, message, n, entities``: distinct entities of each finding, sorted."""
    g = findings.groupBy("level", "kind", "message")
    return g.agg(F.countDistinct("entity").alias("n"), F.array_sort(F.collect_set("entity")).alias("entities"))


def errors(findings: DataFrame, level: str | None = None) -> dict:
    """``{level: {kind: {message: [entities]}}}`` for a report."""
    out: dict = {}
    for r in roll_up(findings if level is None else findings.filter(F.col("level") == level)).collect():
        out.setdefault(r.level, {}).setdefault(r.kind, {})[r.message] = list(r.entities)
    return out


def write_report(findings: DataFrame, to: TextIO, level: str | None = None) -> None:
    """The report as JSON on the given stream."""
    json.dump(errors(findings, level), to, indent=2, sort_keys=True)
    to.write("\n")
