"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder (see :func:`sparkloom.session.shared_dir`)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every endpoint; the component is its least node.

    Self-loops, repeated edges and both orientations are allowed; edges with a null end
    are ignored. Every round is one aggregation and one join of the edges' size, and
    rounds grow with the logarithm of the largest component. Lineage is cut in the
    cluster's shared checkpoint folder after each round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    cur = e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        cur = small.filter("u <> v").distinct().checkpoint()
        seen = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return nodes.join(cur, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
