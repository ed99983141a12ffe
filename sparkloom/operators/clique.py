"""Clique merge: equivalent nodes become one leader, and edges move to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import NS, Catalog, catalog
from ..functions.curie import prefix_of
from ..kg import KG
from .components import connected_components, ensure_checkpoint_dir
from .normalize import edge_key
from .store import TRIPLE, last_values

SAME = f"{NS}:same_as"


def equivalences(kg: KG) -> DataFrame:
    """``a, b`` of the ``same_as`` lists and of the ``same_as`` edges."""
    out = kg.edges.filter(F.col("predicate") == SAME).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    if "same_as" in kg.nodes.columns:
        many = isinstance(kg.nodes.schema["same_as"].dataType, T.ArrayType)
        listed = F.explode("same_as") if many else F.col("same_as")
        out = out.unionByName(kg.nodes.filter("same_as is not null").select(F.col("id").alias("a"), listed.alias("b")))
    return out.filter("a is not null and b is not null").distinct()


def checked_categories(nodes: DataFrame, cat: Catalog | None = None) -> DataFrame:
    """``id, valid, outside, unknown``: a node's categories that are one line of descent,
    those of the model outside that line, and those that are no class (or a mixin).

    The most specific category (most ancestors, mixins included; the first of equals)
    sets the line.
    """
    cat = cat or catalog()
    spark = nodes.sparkSession
    known = cat.ancestor_table(spark).groupBy("category").agg(F.collect_set("ancestor").alias("line"), F.count(F.lit(1)).alias("depth"))
    mixins = [f"{NS}:{c}" for c in cat.classes if cat.is_mixin(c)]
    known = known.filter(~F.col("category").isin(mixins)) if mixins else known
    c = nodes.select("id", F.posexplode("category").alias("pos", "category")).join(F.broadcast(known), "category", "left")
    best = F.max(F.when(F.col("line").isNotNull(), F.struct("depth", (-F.col("pos")).alias("p"), "line")))
    c = c.groupBy("id").agg(best.getField("line").alias("line"), F.array_sort(F.collect_list(F.struct("pos", "category", F.col("line").isNotNull().alias("known")))).alias("all"))
    names = lambda test: F.transform(F.filter("all", test), lambda s: s["category"])
    return c.select(
        "id",
        names(lambda s: s["known"] & F.array_contains("line", s["category"])).alias("valid"),
        names(lambda s: s["known"] & ~F.array_contains("line", s["category"])).alias("outside"),
        names(lambda s: ~s["known"]).alias("unknown"),
    )


def with_categories(kg: KG, pairs: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """``id, category`` of every node, renamed by ``mapping`` (categories that are not of
    the model to those that are); a node without one takes that of its equivalent node of
    the least id that has one."""
    own = kg.nodes.select("id", "category" if isinstance(kg.nodes.schema["category"].dataType, T.ArrayType) else F.array("category").alias("category"))
    if mapping:
        names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        own = own.withColumn("category", F.transform("category", lambda c: F.coalesce(names[c], c)))
    has = own.filter(F.size(F.filter("category", lambda c: c.isNotNull())) > 0)
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("id", "other")
    lent = both.join(has.select("id"), "id", "left_anti").join(has.toDF("other", "category"), "other")
    return has.unionByName(lent.groupBy("id").agg(F.min_by("category", "other").alias("category")))


def _lines(spark, cat: Catalog) -> DataFrame:
    return cat.ancestor_table(spark).groupBy("category").agg(F.collect_set("ancestor").alias("line"), F.count(F.lit(1)).alias("depth"))


def clique_categories(comp: DataFrame, valid: DataFrame, cat: Catalog | None = None) -> DataFrame:
    """``clique, category, line, categories``: the most specific category of the members
    (of most ancestors, the first by name of equals), its ancestors, and the members'
    categories with all above them, from the most specific to the most general."""
    cat = cat or catalog()
    lines = F.broadcast(_lines(comp.sparkSession, cat))
    named = comp.join(valid.select("id", F.explode("valid").alias("category")), "id").select("clique", "category").distinct()
    every = named.join(lines, "category").select("clique", F.explode("line").alias("category")).distinct().join(lines, "category")
    order = F.array_sort(F.collect_set(F.struct((-F.col("depth")).alias("d"), "category")))
    top = named.join(lines, "category").groupBy("clique").agg(F.min_by(F.struct("category", "line"), F.struct(-F.col("depth"), "category")).alias("k"))
    return every.groupBy("clique").agg(F.transform(order, lambda x: x["category"]).alias("categories")).join(top, "clique").select("clique", "k.category", "k.line", "categories")


def cliques(kg: KG, strict: bool = True, cat: Catalog | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """``id, clique`` of the equivalent nodes.

    Components are found; with ``strict``, nodes whose category is not on the line of
    their component's category are expelled, and where any was, components are found
    again, since one that held two parts together may be gone.
    """
    ensure_checkpoint_dir(kg.nodes.sparkSession)
    pairs = equivalences(kg).checkpoint()
    comp = connected_components(pairs, "a", "b").toDF("id", "clique").checkpoint()  # joined several times below
    if not strict or "category" not in kg.nodes.columns:
        return comp
    cat = cat or catalog()
    valid = checked_categories(with_categories(kg, pairs, mapping).join(comp.select("id"), "id", "left_semi"), cat).checkpoint()
    member = comp.join(valid, "id")
    kind = clique_categories(comp, valid, cat).select("clique", "line")
    bad = member.join(kind, "clique").filter((F.size("valid") > 0) & ~F.arrays_overlap("valid", "line")).select(F.col("id").alias("x"))
    bad = bad.union(valid.filter(F.size("outside") > 0).select("id")).distinct().checkpoint()
    if bad.isEmpty():
        return comp
    left = pairs.join(bad, F.col("a") == F.col("x"), "left_anti").join(bad, F.col("b") == F.col("x"), "left_anti")
    return connected_components(left, "a", "b").toDF("id", "clique").checkpoint()


def leaders(kg: KG, comp: DataFrame, annotation: str = "clique_leader", priority: list[str] | None = None, by_category: dict[str, list[str]] | None = None) -> DataFrame:
    """``clique, leader, election_strategy``.

    A member that carries the annotation wins, then the member of the best prefix, then
    that of the first prefix by name. Ties go to the least id. ``by_category`` gives a
    category's own order of prefixes.
    """
    nodes, spark = kg.nodes, kg.nodes.sparkSession
    cols = ["id", *[c for c in (annotation, "category") if c in nodes.columns]]
    m = comp.join(nodes.select(*cols), "id", "left")
    if annotation in nodes.columns:
        marked = F.lower(F.concat_ws("|", F.col(annotation)) if isinstance(nodes.schema[annotation].dataType, T.ArrayType) else F.col(annotation).cast("string")) == "true"
    else:
        marked = F.lit(False)
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(priority or []))):
        rank = F.when(F.col("id").contains(p), i).otherwise(rank)
    if by_category and "category" in nodes.columns:
        table = spark.createDataFrame([(c, p, i) for c, ps in by_category.items() for i, p in enumerate(ps)], "c string, p string, r int")
        first = m.select("id", (F.element_at("category", 1) if isinstance(nodes.schema["category"].dataType, T.ArrayType) else F.col("category")).alias("c"), prefix_of("id").alias("p"))
        m = m.join(first.join(F.broadcast(table), ["c", "p"]).select("id", "r"), "id", "left")
        rank = F.coalesce("r", rank)
    m = m.select("clique", "id", F.coalesce(marked, F.lit(False)).alias("marked"), rank.alias("rank"), prefix_of("id").alias("prefix"))
    how = F.when(F.col("marked"), "LEADER_ANNOTATION").when(F.col("rank").isNotNull(), "PREFIX_PRIORITIZATION").otherwise("ALPHABETICAL_SORT")
    m = m.withColumn("k", F.struct((~F.col("marked")).alias("a"), F.coalesce("rank", F.lit(1 << 30)).alias("b"), F.coalesce("prefix", F.lit("￿")).alias("c"), F.col("id").alias("d")))
    best = m.groupBy("clique").agg(F.min_by(F.struct("id", how.alias("how")), "k").alias("w"))
    return best.select("clique", F.col("w.id").alias("leader"), F.col("w.how").alias("election_strategy"))


def clique_merge(kg: KG, annotation: str = "clique_leader", priority: list[str] | None = None, by_category: dict[str, list[str]] | None = None, strict: bool = True, category_mapping: dict[str, str] | None = None) -> KG:
    """Equivalent nodes collapse into their leader. ``category_mapping`` names the model's
    categories for others, before they are checked.

    Edges move to it, with the true ends in ``_original_subject`` and
    ``_original_object``; ``same_as`` edges go, as do ``subclass_of`` loops that arise.
    The leader's ``same_as`` lists the other members, which are removed.
    """
    comp = cliques(kg, strict, mapping=category_mapping)
    lead = leaders(kg, comp, annotation, priority, by_category)
    who = comp.join(lead, "clique").select("id", "leader", "election_strategy").checkpoint()  # as many rows as equivalent nodes
    edges = kg.edges.filter((F.col("predicate") != SAME) | F.col("predicate").isNull())
    for end in ("subject", "object"):
        m = who.filter("id <> leader").select(F.col("id").alias("_from"), F.col("leader").alias("_to"))
        edges = edges.join(m, F.col(end) == F.col("_from"), "left")
        edges = edges.withColumn(f"_original_{end}", F.when(F.col("_to").isNotNull(), F.col(end))).withColumn(end, F.coalesce("_to", end)).drop("_from", "_to")
    loop = (F.col("predicate") == f"{NS}:subclass_of") & (F.col("subject") == F.col("object")) & (F.col("_original_subject").isNotNull() | F.col("_original_object").isNotNull())
    edges = edges.filter(~F.coalesce(loop, F.lit(False))).drop("edge_key")
    edges = last_values(edges.withColumn("_seq", F.concat_ws("-", "_original_subject", "_original_object")), TRIPLE, "_seq").withColumn("edge_key", edge_key())  # the key follows from these
    same = who.filter("id <> leader").groupBy("leader").agg(F.array_sort(F.collect_set("id")).alias("_members"))
    elected = who.filter("id = leader").select("id", "election_strategy")
    nodes = kg.nodes.join(who.filter("id <> leader").select("id"), "id", "left_anti").drop("same_as", annotation, "election_strategy")
    nodes = nodes.join(same, F.col("id") == F.col("leader"), "left").drop("leader").withColumnRenamed("_members", "same_as").join(elected, "id", "left")
    return kg.with_(nodes=nodes.withColumn("clique_leader", F.when(F.col("election_strategy").isNotNull(), True)), edges=edges)
