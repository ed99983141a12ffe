"""Parents, ancestors, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import NS
from ..kg import KG
from .components import ensure_checkpoint_dir

SUBCLASS = (f"{NS}:subclass_of", "subclass_of", "rdfs:subClassOf")


def parents(kg: KG, relations: tuple[str, ...] = SUBCLASS) -> DataFrame:
    """``id, parent`` along the relations."""
    return kg.edges.filter(F.col("predicate").isin(*relations)).select(F.col("subject").alias("id"), F.col("object").alias("parent")).distinct()


def ancestors(kg: KG, start: DataFrame | None = None, relations: tuple[str, ...] = SUBCLASS) -> DataFrame:
    """``id, ancestor, distance`` of the transitive closure, least distances, without the
    nodes themselves.

    Distances double in each round, so that rounds grow with the logarithm of the
    longest chain; cycles end by themselves. ``start`` (``id``) limits the result, by
    widening from those nodes one step a round.
    """
    ensure_checkpoint_dir(kg.edges.sparkSession)
    step = parents(kg, relations).filter("id <> parent").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).checkpoint()
    hop = step.select(F.col("id").alias("mid"), F.col("ancestor").alias("far"), F.col("distance").alias("d"))
    reach = step.join(start.select("id").distinct(), "id", "left_semi") if start is not None else step
    known = reach.checkpoint()
    n = known.count()
    while True:
        other = hop if start is not None else known.select(F.col("id").alias("mid"), F.col("ancestor").alias("far"), F.col("distance").alias("d"))
        longer = known.join(other, F.col("ancestor") == F.col("mid")).filter("id <> far").select("id", F.col("far").alias("ancestor"), (F.col("distance") + F.col("d")).alias("distance"))
        known = known.unionByName(longer).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")).checkpoint()
        m = known.count()
        if m == n:
            return known
        n = m


def inferred_categories(kg: KG, top: dict[str, str], relations: tuple[str, ...] = SUBCLASS) -> DataFrame:
    """``id, category``: of the nearest ancestor (or the node) that the table maps; the
    least category of equally near ones."""
    table = kg.nodes.sparkSession.createDataFrame(list(top.items()), "ancestor string, category string")
    reach = ancestors(kg, relations=relations).unionByName(kg.nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))
    return reach.join(F.broadcast(table), "ancestor").groupBy("id").agg(F.min(F.struct("distance", "category")).getField("category").alias("category"))


def labels(df: DataFrame, column: str, names: DataFrame, to: str = "label") -> DataFrame:
    """``df`` with the label of a CURIE column, from ``id, label``; the CURIE without one."""
    n = names.select(F.col("id").alias("_k"), F.col("label").alias("_l"))
    return df.join(n, F.col(column) == F.col("_k"), "left").withColumn(to, F.coalesce("_l", column)).drop("_k", "_l")
