"""The driver's relational tables seen as a property graph, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import NS
from ..kg import KG
from ..session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


NODE_TABLES = (
    ("region", "REGION", "r_regionkey", "r_name", "GeographicLocation"),
    ("nation", "NATION", "n_nationkey", "n_name", "GeographicLocation"),
    ("customer", "CUST", "c_custkey", "c_name", "Agent"),
    ("supplier", "SUPP", "s_suppkey", "s_name", "Agent"),
    ("part", "PART", "p_partkey", "p_name", "PhysicalEntity"),
    ("orders", "ORD", "o_orderkey", None, "Event"),
)
EDGE_TABLES = (
    ("nation", "NATION", "n_nationkey", "part_of", "REGION", "n_regionkey"),
    ("customer", "CUST", "c_custkey", "located_in", "NATION", "c_nationkey"),
    ("supplier", "SUPP", "s_suppkey", "located_in", "NATION", "s_nationkey"),
    ("orders", "ORD", "o_orderkey", "has_participant", "CUST", "o_custkey"),
    ("lineitem", "ORD", "l_orderkey", "has_input", "PART", "l_partkey"),
    ("lineitem", "SUPP", "l_suppkey", "provides", "PART", "l_partkey"),
)


def nodes(spark: SparkSession, sf_dir: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """``id, name, category, provided_by`` of every row of the node tables."""
    parts = [
        read(spark, sf_dir, t).select(_id(p, k).alias("id"), (F.col(n) if n else F.lit(None).cast("string")).alias("name"), F.array(F.lit(f"{NS}:{c}")).alias("category"), F.lit(t).alias("provided_by"))
        for t, p, k, n, c in NODE_TABLES
        if t not in leave_out
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``subject, predicate, object, aks, quantity, seq``; lines repeat edges."""
    parts = []
    for t, sp, sk, pred, op, ok in EDGE_TABLES:
        df = read(spark, sf_dir, t)
        line = t == "lineitem"
        parts.append(
            df.select(
                _id(sp, sk).alias("subject"), F.lit(f"{NS}:{pred}").alias("predicate"), _id(op, ok).alias("object"), F.lit(t).alias("aks"),
                (F.col("l_quantity") if line else F.lit(None)).cast("long").alias("quantity"),
                (F.col("l_orderkey") * 8 + F.col("l_linenumber") if line else F.lit(0)).cast("long").alias("seq"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def graph(spark: SparkSession, sf_dir: str) -> KG:
    return KG(nodes(spark, sf_dir), edges(spark, sf_dir), "tables")


NODES_SQL = " union all ".join(f"select '{p}:' || {k} as id, {n or 'null'} as name, '{NS}:{c}' as category, '{t}' as provided_by from {t}" for t, p, k, n, c in NODE_TABLES)
EDGES_SQL = " union all ".join(
    f"select '{sp}:' || {sk} as subject, '{NS}:{pred}' as predicate, '{op}:' || {ok} as object, '{t}' as aks, "
    f"{'l_quantity::bigint' if t == 'lineitem' else 'null::bigint'} as quantity, {'(l_orderkey * 8 + l_linenumber)::bigint' if t == 'lineitem' else '0::bigint'} as seq from {t}"
    for t, sp, sk, pred, op, ok in EDGE_TABLES
)
WITH = f"with recursive n as ({NODES_SQL}), e as ({EDGES_SQL})"
