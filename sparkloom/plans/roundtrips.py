"""A graph written and read again, format by format."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..kg import KG
from ..session import temporary
from ..sinks import files
from ..sources import databases, delimited, jsons, rdf
from ..sources.common import ReadOptions


def _base(spark: SparkSession) -> str:
    return temporary(spark, "roundtrips") + "/g"


def tsv(spark: SparkSession, kg: KG) -> KG:
    return delimited.load(spark, list(files.write_delimited(kg, _base(spark), "tsv")), "tsv")


def jsonl(spark: SparkSession, kg: KG) -> KG:
    return jsons.load_jsonl(spark, list(files.write_jsonl(kg, _base(spark), "gzip", rows_a_file=1_000_000)))


def parquet(spark: SparkSession, kg: KG) -> KG:
    base = _base(spark)
    kg.edges.write.parquet(f"{base}_e")
    kg.nodes.write.parquet(f"{base}_n")
    return databases.load_parquet(spark, f"{base}_n", f"{base}_e")


def ntriples(spark: SparkSession, kg: KG) -> KG:
    return rdf.load_ntriples(spark, files.write_ntriples(kg, _base(spark) + ".nt"), ReadOptions())
