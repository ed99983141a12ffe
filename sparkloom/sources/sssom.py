"""Mapping sets: tab-separated, with a commented YAML header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import DEFAULT_PREDICATE, NS
from ..functions.curie import is_curie
from ..kg import KG
from .common import ReadOptions, finish, with_seq
from .jsons import predicate_of

NODE_COLUMNS = {"id": "id", "label": "name", "category": "category", "source": "source", "match_field": None}


def header(spark: SparkSession, path: str) -> dict:
    """The metadata before the table: simple ``key: value`` lines and one level of maps."""
    lines = [r.value[1:] for r in spark.read.text(path).filter(F.col("value").startswith("#")).limit(10_000).collect()]
    try:
        import yaml

        return yaml.safe_load("\n".join(x[1:] if x.startswith(" ") and not x.startswith("  ") else x for x in lines)) or {}
    except ImportError:
        out: dict = {}
        for x in lines:
            k, _, v = x.strip().partition(":")
            if v.strip():
                out[k] = v.strip().strip('"')
        return out


def load(spark: SparkSession, path: str, o: ReadOptions = ReadOptions(), name: str = "graph") -> KG:
    """Each mapping is an edge between its subject and object, which become nodes.

    Header keys other than the prefix map are edge properties; the provider is the
    knowledge source. A category that is no CURIE becomes the ontology class.
    """
    meta = header(spark, path)
    t = with_seq(spark.read.option("sep", "\t").option("header", True).option("comment", "#").option("quote", "").csv(path))
    parts: list[DataFrame] = []
    for end in ("subject", "object"):
        cols = [F.col(f"{end}_id").alias("id"), "seq"]
        if f"{end}_label" in t.columns:
            cols.append(F.col(f"{end}_label").alias("name"))
        if f"{end}_category" in t.columns:
            c = F.col(f"{end}_category")
            cols.append(F.when(is_curie(c), c).otherwise(F.when(c.isNotNull(), F.lit(f"{NS}:OntologyClass"))).alias("category"))
        parts.append(t.select(*cols))
    nodes = parts[0].unionByName(parts[1], allowMissingColumns=True)
    skip = {f"{end}_{k}" for end in ("subject", "object") for k in NODE_COLUMNS} | {"predicate_id", "seq"}
    pred = F.coalesce(predicate_of(F.col("predicate_id")), F.lit(DEFAULT_PREDICATE))
    edges = t.select(F.col("subject_id").alias("subject"), pred.alias("predicate"), F.col("object_id").alias("object"), F.col("predicate_id").alias("relation"), "seq", *[c for c in t.columns if c not in skip])
    for k, v in meta.items():
        if k != "curie_map" and not isinstance(v, dict):
            edges = edges.withColumn("knowledge_source" if k == "mapping_provider" else k, F.array(*[F.lit(str(x)) for x in v]) if isinstance(v, list) else F.lit(str(v)))
    return finish(nodes, edges, o, name, spark)
