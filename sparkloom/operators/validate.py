"""Validation against the model: one report of findings per graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import IMPORT_TYPES, NS, REQUIRED_EDGE, REQUIRED_NODE, Catalog, catalog
from ..functions.curie import constants, is_curie, prefix_of
from ..kg import KG
from .normalize import col, null_if_blank
from .report import SCHEMA, finding

CAMEL = r"^(?:[A-Z][a-z\d]+)+$"
SNAKE = r"^[a-z]+(?:_[a-z\d]+)*$"


def _entity(edges: bool) -> Column:
    return F.concat(F.coalesce("subject", F.lit("")), F.lit("-"), F.coalesce("object", F.lit(""))) if edges else F.coalesce("id", F.lit(""))


def missing(df: DataFrame, required: tuple[str, ...], edges: bool) -> DataFrame:
    """Required properties that a record lacks; an empty list is lacking."""
    kind = "MISSING_EDGE_PROPERTY" if edges else "MISSING_NODE_PROPERTY"
    tests = []
    for p in required:
        if p not in df.columns:
            absent = F.lit(True)
        elif isinstance(df.schema[p].dataType, T.ArrayType):
            absent = col(p).isNull() | (F.size(col(p)) == 0)
        else:
            absent = null_if_blank(col(p).cast("string")).isNull()
        if edges and p == "id" and "association_id" in df.columns:
            absent = absent & F.col("association_id").isNull()
        tests.append(F.when(absent, F.lit(p)))
    rows = df.select(_entity(edges).alias("e"), F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("p"))
    return rows.select(*finding(F.col("e"), kind, F.concat(F.lit("Required property '"), F.col("p"), F.lit("' is missing"))))


def wrong_types(df: DataFrame, edges: bool, cat: Catalog | None = None) -> DataFrame:
    """Properties whose column type does not fit the declared type or multiplicity, for
    the records that have a value."""
    cat = cat or catalog()
    kind = "INVALID_EDGE_PROPERTY_VALUE_TYPE" if edges else "INVALID_NODE_PROPERTY_VALUE_TYPE"
    tests = []
    for f in df.schema.fields:
        many = isinstance(f.dataType, T.ArrayType)
        declared = IMPORT_TYPES.get(f.name)
        if declared == "list" and not many:
            message = f"Multi-valued property '{f.name}' is defined as {f.dataType.simpleString()}"
        elif (declared == "str" or f.name in ("id", "subject", "predicate", "object", "name", "description", "relation")) and not isinstance(f.dataType, T.StringType):
            message = f"Single-valued property '{f.name}' is defined as {f.dataType.simpleString()}"
        elif declared == "bool" and not isinstance(f.dataType, T.BooleanType):
            message = f"Boolean property '{f.name}' is defined as {f.dataType.simpleString()}"
        else:
            continue
        tests.append(F.when(col(f.name).isNotNull(), F.lit(message)))
    if not tests:
        return df.sparkSession.createDataFrame([], SCHEMA)
    rows = df.select(_entity(edges).alias("e"), F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("m"))
    return rows.select(*finding(F.col("e"), kind, F.col("m")))


def bad_ids(df: DataFrame, columns: tuple[str, ...], edges: bool, prefixes: set[str]) -> DataFrame:
    """Identifiers that are no CURIE, and (as a warning) those of an unknown prefix."""
    kind = "INVALID_EDGE_PROPERTY_VALUE" if edges else "INVALID_NODE_PROPERTY_VALUE"
    known = constants(sorted(prefixes))
    parts = [F.struct(F.lit(c).alias("c"), col(c).alias("v")) for c in columns]
    rows = df.select(_entity(edges).alias("e"), F.explode(F.array(*parts)).alias("s")).select("e", "s.c", "s.v").filter("v is not null")
    no = rows.filter(~is_curie("v")).select(*finding(F.col("e"), kind, F.concat(F.lit("Property '"), F.col("c"), F.lit("' is not a CURIE"))))
    what = rows.filter(is_curie("v") & ~F.array_contains(known, prefix_of("v")))
    return no.unionByName(what.select(*finding(F.col("e"), kind, F.concat(F.lit("Property '"), F.col("c"), F.lit("' has the unknown prefix '"), prefix_of("v"), F.lit("'")), "WARNING")))


def bad_categories(nodes: DataFrame, cat: Catalog | None = None) -> DataFrame:
    """Categories that are malformed, mixins, unknown, or aliases of a class."""
    cat = cat or catalog()
    c = F.col("category")
    many = isinstance(nodes.schema["category"].dataType, T.ArrayType)
    name = F.regexp_replace("c", f"^{NS}:", "")
    rows = nodes.select(F.coalesce("id", F.lit("")).alias("e"), (F.explode(c) if many else c).alias("c")).filter("c is not null").withColumn("n", name)
    table = [(k, "mixin" if cat.is_mixin(k) else "class") for k in cat.classes] + [(a, "alias") for a in cat.aliases() if a not in cat.classes]
    known = F.broadcast(nodes.sparkSession.createDataFrame(table, "n string, t string"))
    rows = rows.join(known, "n", "left")
    why = (
        F.when(F.col("t") == "class", None)
        .when(F.col("t") == "alias", F.lit("is an alias"))
        .when(~F.col("n").rlike(CAMEL), F.lit("is not in CamelCase form"))
        .when(F.col("t") == "mixin", F.lit("is a mixin"))
        .otherwise(F.lit("is unknown"))
    )
    rows = rows.withColumn("w", why).filter("w is not null")
    return rows.select(*finding(F.col("e"), "INVALID_CATEGORY", F.concat(F.lit("Category '"), F.col("c"), F.lit("' "), F.col("w"))))


def bad_predicates(edges: DataFrame, cat: Catalog | None = None) -> DataFrame:
    """Predicates that are malformed or unknown."""
    cat = cat or catalog()
    p = F.col("predicate")
    n = F.regexp_replace(p, f"^{NS}:", "")
    known = constants(cat.predicates)
    why = F.when(~n.rlike(SNAKE), F.lit("is not in snake_case form")).when(~F.array_contains(known, n), F.lit("is unknown"))
    rows = edges.filter("predicate is not null").withColumn("w", why).filter("w is not null")
    return rows.select(*finding(_entity(True), "INVALID_EDGE_PREDICATE", F.concat(F.lit("Predicate '"), p, F.lit("' "), F.col("w"))))


def validate_nodes(nodes: DataFrame, prefixes: set[str] | None = None, cat: Catalog | None = None, required: tuple[str, ...] = REQUIRED_NODE) -> DataFrame:
    """Findings on nodes: one pass over the table for each group of checks."""
    cat = cat or catalog()
    prefixes = prefixes if prefixes is not None else set(cat.prefixes)
    parts = [missing(nodes, required, False), wrong_types(nodes, False, cat), bad_ids(nodes, ("id",), False, prefixes)]
    if "category" in nodes.columns:
        parts.append(bad_categories(nodes, cat))
    return reduce(DataFrame.unionByName, parts)


def validate_edges(edges: DataFrame, prefixes: set[str] | None = None, cat: Catalog | None = None, required: tuple[str, ...] = REQUIRED_EDGE) -> DataFrame:
    """Findings on edges."""
    cat = cat or catalog()
    prefixes = prefixes if prefixes is not None else set(cat.prefixes)
    ends = tuple(c for c in ("subject", "object") if c in edges.columns)
    parts = [missing(edges, required, True), wrong_types(edges, True, cat), bad_ids(edges, ends, True, prefixes)]
    if "predicate" in edges.columns:
        parts.append(bad_predicates(edges, cat))
    return reduce(DataFrame.unionByName, parts)


def validate(kg: KG, prefixes: set[str] | None = None, cat: Catalog | None = None) -> DataFrame:
    """All findings on a graph: ``entity, level, kind, message``."""
    return validate_nodes(kg.nodes, prefixes, cat).unionByName(validate_edges(kg.edges, prefixes, cat))


def dropped_nodes(nodes: DataFrame) -> DataFrame:
    """Findings on the records that import leaves out or completes: no id, no category."""
    lacks = null_if_blank(F.col("id")).isNull()
    kind = nodes.schema["category"].dataType if "category" in nodes.columns else None
    bare = F.lit(True) if kind is None else F.size("category") < 1 if isinstance(kind, T.ArrayType) else null_if_blank(F.col("category")).isNull()
    none = nodes.filter(lacks).select(*finding(F.lit(""), "MISSING_NODE_PROPERTY", "Required property 'id' is missing"))
    return none.unionByName(nodes.filter(~lacks & F.coalesce(bare, F.lit(True))).select(*finding(F.col("id"), "MISSING_CATEGORY", "No category; the default one is taken", "WARNING")))


def dropped_edges(edges: DataFrame) -> DataFrame:
    """Findings on the edges that import leaves out, one for each part that is missing."""
    lacks = [F.when(null_if_blank(F.col(c)).isNull(), F.lit(c)) for c in ("subject", "predicate", "object")]
    rows = edges.select(_entity(True).alias("e"), F.explode(F.filter(F.array(*lacks), lambda x: x.isNotNull())).alias("p"))
    kind = F.when(F.col("p") == "predicate", "MISSING_EDGE_PREDICATE").otherwise("MISSING_EDGE_PROPERTY").alias("kind")
    return rows.select(F.col("e").alias("entity"), F.lit("ERROR").alias("level"), kind, F.concat(F.lit("Required property '"), F.col("p"), F.lit("' is missing")).alias("message"))
