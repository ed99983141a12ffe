"""Record rules at import and export: required fields, list and boolean typing, nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import DEFAULT_CATEGORY, IMPORT_TYPES, LIST_SLOTS
from ..functions.curie import new_uuid, stable_id


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def null_if_blank(c: Column) -> Column:
    """Null for the spellings of no value: empty and a single space."""
    return F.when(~c.isin("", " "), c)


def clean_list(c: Column) -> Column:
    """A list without null and blank members; an empty list stays one."""
    return F.filter(c, lambda x: x.isNotNull() & ~x.isin("", " "))


def drop_nulls(df: DataFrame) -> DataFrame:
    """Every string and list column with its blanks made null or left out."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out.append(null_if_blank(col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out.append(clean_list(col(f.name)).alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            out.append(F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def _spaces(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))  # no regular expression: it is run on every cell


def split_list(c: Column, delimiter: str | None) -> Column:
    """Parts of a string without empty ones; the whole string without a delimiter."""
    if not delimiter:
        return F.array(c)
    return F.filter(F.split(c, "\\Q" + delimiter + "\\E"), lambda x: x != "")


def list_columns(df: DataFrame, delimiter: str | None, names: list[str]) -> set[str]:
    """Undeclared string columns that hold the delimiter in any row: one aggregation for
    all of them, since a column is a list for the whole table or not at all."""
    if not delimiter or not names:
        return set()
    row = df.agg(*[F.coalesce(F.bool_or(col(n).contains(delimiter)), F.lit(False)).alias(n) for n in names]).first()
    return {n for n, v in zip(names, row) if v}


def undeclared_lists(df: DataFrame, delimiter: str | None) -> set[str]:
    """:func:`list_columns` of all undeclared string columns."""
    return list_columns(df, delimiter, [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in IMPORT_TYPES])


def sanitize_import(df: DataFrame, delimiter: str | None = "|", lists: set[str] | None = None) -> DataFrame:
    """Typed columns as at import.

    Declared lists are split, cleaned, made distinct and sorted; declared booleans are
    true for any non-empty string (also "False") and any non-zero number; undeclared
    strings with the delimiter become lists in their order; integers become strings.
    ``lists`` names the undeclared list columns where they are known, which saves the
    aggregation that finds them.
    """
    df = drop_nulls(df)
    lists = undeclared_lists(df, delimiter) if lists is None else lists
    out = []
    for f in df.schema.fields:
        c, t, kind = col(f.name), f.dataType, IMPORT_TYPES.get(f.name)
        if kind == "list":
            if isinstance(t, T.StringType):
                c = split_list(_spaces(c), delimiter)
            elif isinstance(t, T.ArrayType):
                c = F.transform(c, lambda x: _spaces(x.cast("string")))
            else:
                c = F.when(c.isNotNull(), F.array(c.cast("string")))
            c = F.array_sort(F.array_distinct(c))
        elif kind == "bool":
            if isinstance(t, T.StringType):
                c = F.when(c.isNotNull(), F.lit(True))
            elif not isinstance(t, T.BooleanType):
                c = c != 0
        elif isinstance(t, T.StringType):
            if f.name in lists:
                c = split_list(_spaces(c), delimiter)
            elif f.name in LIST_SLOTS:
                c = F.when(c.isNotNull(), F.array(c))
            else:
                c = _spaces(c)
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            c = F.transform(c, _spaces)
        elif isinstance(t, (T.IntegralType, T.DecimalType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def sanitize_export(df: DataFrame, delimiter: str = "|") -> DataFrame:
    """String columns for delimited output: lists are joined, line breaks, tabs and
    escaped quotes cleaned, and values that count as false (0, false, empty) are null."""
    out = []
    for f in df.schema.fields:
        c, t = col(f.name), f.dataType
        if isinstance(t, T.ArrayType):
            parts = F.transform(clean_list(c.cast("array<string>")), lambda x: F.replace(_spaces(x), F.lit('\\"')))
            c = F.when(F.size(parts) > 0, F.concat_ws(delimiter, parts))
        elif isinstance(t, T.BooleanType):
            c = F.when(c, F.lit("True"))
        elif isinstance(t, T.NumericType):
            c = F.when(c != 0, c.cast("string"))
        elif isinstance(t, T.StringType):
            c = F.replace(_spaces(null_if_blank(c)), F.lit('\\"'))
        else:
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def distinct_rows(df: DataFrame, n: int, most: int = 500_000) -> DataFrame:
    """The distinct rows of about ``n``, most of which are so already. They are divided
    before any are compared, a task having ``most`` on average: else each task would first
    compare all rows that it read, in a table that outgrows its memory and saves nothing."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // most))
    return df.repartition(parts, *[col(c) for c in df.columns]).distinct()


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Rows with an id; an absent category becomes the default one."""
    out = nodes.filter(null_if_blank(F.col("id")).isNotNull())
    if "category" not in nodes.columns:
        return out.withColumn("category", F.array(F.lit(DEFAULT_CATEGORY)))
    if isinstance(nodes.schema["category"].dataType, T.ArrayType):
        return out.withColumn("category", F.coalesce("category", F.array(F.lit(DEFAULT_CATEGORY))))
    return out.withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY)))


def valid_edges(edges: DataFrame) -> DataFrame:
    """Rows with subject, predicate and object."""
    for n in ("subject", "predicate", "object"):
        edges = edges.filter(null_if_blank(F.col(n)).isNotNull())
    return edges


def edge_key() -> Column:
    """``subject-predicate-object``."""
    return F.concat_ws("-", "subject", "predicate", "object")


def with_edge_ids(edges: DataFrame, stable: bool = False) -> DataFrame:
    """Fill missing edge ids: random, or determined by the edge where ``stable``, which a
    retried task reproduces."""
    new = stable_id("subject", "predicate", "object") if stable else new_uuid()
    return edges.withColumn("id", F.coalesce(F.col("id"), new) if "id" in edges.columns else new)


def remade(edges: DataFrame, made: tuple[str, ...]) -> DataFrame:
    """Edges with the columns of ``made``, computed anew."""
    if "id" in made:
        edges = edges.withColumn("id", stable_id("subject", "predicate", "object"))
    return edges.withColumn("edge_key", edge_key()) if "edge_key" in made else edges


def used_properties(df: DataFrame) -> list[str]:
    """Names of the columns that hold a value in some row, in one aggregation."""
    row = df.agg(*[F.coalesce(F.bool_or(col(c).isNotNull()), F.lit(False)).alias(c) for c in df.columns]).first()
    return [c for c, v in zip(df.columns, row) if v]
