"""The corpus pipeline: five stages from raw documents to packed training windows.

Each stage takes ``(spark, docs, sf_dir)``, works on all the rows that its predecessor
kept, and is written as Parquet and reread before the next. All but the last return
the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import chosenpath, mixing, packing, pii, quality
from sparkloom.llm.scratch import table
from sparkloom.session import ship

SEVERAL = "\x1f"  # between the sources of a document that stands for several


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose perplexity lies outside their language's band."""
    ship(spark)
    return quality.filtered(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of every group of similar ones, with the sources
    of the whole group."""
    ship(spark)
    return chosenpath.deduplicated(docs, sources=SEVERAL)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data and secrets in the texts."""
    ship(spark)
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Choose and repeat documents so that the sources' shares meet their targets."""
    ship(spark)
    return mixing.mixed(docs, mixing.Mix(several=SEVERAL))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents, in order, into windows; repeats of one lie far apart."""
    ship(spark)
    return packing.packed(docs, packing.Pack(spread=True))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("PII", personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None  # perplexities, sampled paths, message passing and the flow are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
