"""Provenance: knowledge-source columns, their defaults and rewriting to identifiers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import IMPORT_TYPES, PROVENANCE
from .normalize import col

Spec = bool | str | tuple | dict


def infores(c: Column, pattern: str | None = None, substitute: str = "", prefix: str = "") -> Column:
    """A source name as an ``infores:`` identifier; one that is already so stays."""
    x = F.regexp_replace(c, pattern, substitute) if pattern else c
    x = F.lower(F.trim(F.concat(F.lit(prefix + " "), x)))
    for a, b in ((r"\s+", "_"), (r"\.+", "_"), (r"[^\w]", ""), ("_", "-")):
        x = F.regexp_replace(x, a, b)
    return F.when(c.startswith("infores:"), c).otherwise(F.concat(F.lit("infores:"), x))


@dataclass(frozen=True)
class Provenance:
    """What to do with each provenance column.

    ``True`` rewrites to identifiers, ``False`` leaves the column out, a string is the
    value where there is none, and ``(pattern, substitute, prefix)`` rewrites after a
    substitution (the last two optional). A dictionary holds such a tuple or ``True`` by
    pattern: the first whose pattern a value matches is used.
    """

    specs: dict[str, Spec] = field(default_factory=dict, hash=False)
    default: str = "graph"

    @staticmethod
    def of(options: dict, default: str = "graph") -> Provenance:
        """From reader options; other options are ignored."""
        return Provenance({k: v for k, v in options.items() if k in PROVENANCE}, default)

    def _value(self, c: Column, spec: Spec) -> Column:
        if spec is True:
            return infores(c)
        if isinstance(spec, (tuple, list)):
            rest = [*spec[1:], "", ""]
            return infores(c, spec[0] or None, rest[0] or "", rest[1] or "")
        if isinstance(spec, dict):
            out = infores(c)
            for pattern, s in reversed(list(spec.items())):
                out = F.when(c.rlike(pattern), self._value(c, s)).otherwise(out)
            return out
        return c

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with one provenance column treated; it is made if a default exists."""
        spec = self.specs.get(name)
        if spec is False:
            return df.drop(name) if name in df.columns else df
        many = IMPORT_TYPES[name] == "list"
        kind = "array<string>" if many else "string"
        fallback = F.lit(spec if isinstance(spec, str) else infores_text(self.default) if spec else self.default)
        fallback = F.array(fallback) if many else fallback
        if name not in df.columns:
            return df.withColumn(name, fallback.cast(kind))
        c = col(name)
        if isinstance(df.schema[name].dataType, T.ArrayType) and not many:
            c = F.concat_ws("|", c)
        elif many and not isinstance(df.schema[name].dataType, T.ArrayType):
            c = F.when(c.isNotNull(), F.array(c.cast("string")))
        if spec is not None and not isinstance(spec, str):
            c = F.transform(c, lambda x: self._value(x, spec)) if many else self._value(c, spec)
        return df.withColumn(name, F.coalesce(c, fallback))

    def nodes(self, nodes: DataFrame) -> DataFrame:
        """Nodes with ``provided_by``."""
        return self.apply(nodes, "provided_by")

    def edges(self, edges: DataFrame) -> DataFrame:
        """Edges with every provenance column that they have or that is asked for, and
        ``knowledge_source`` if there is none."""
        have = [p for p in PROVENANCE if p in edges.columns]
        names = dict.fromkeys([*have, *[p for p in self.specs if p != "provided_by"]])
        if not any(p != "provided_by" for p in names):
            names["knowledge_source"] = None
        for p in names:
            edges = self.apply(edges, p)
        return edges


def infores_text(s: str) -> str:
    """:func:`infores` of a driver-side string."""
    if s.startswith("infores:"):
        return s
    s = re.sub(r"\.+", "_", re.sub(r"\s+", "_", s.strip().lower()))
    return "infores:" + re.sub(r"\W", "", s).replace("_", "-")


def infores_catalog(df: DataFrame, name: str, pattern: str | None = None, substitute: str = "", prefix: str = "") -> DataFrame:
    """``source, infores`` of every distinct source name."""
    many = isinstance(df.schema[name].dataType, T.ArrayType)
    s = df.select((F.explode(col(name)) if many else col(name)).alias("source")).filter("source is not null").distinct()
    return s.select("source", infores(F.col("source"), pattern, substitute, prefix).alias("infores"))
