"""Exact top-k search by a three-phase uniform threshold (Cao and Wang 2004).

A query's terms are the nodes, each with a list of (document, score); a document's score
is the sum over the lists. Phase 1 gathers the head of every list; the k-th partial sum
divided by the number of lists is a safe cutoff. Phase 2 collects all entries that reach
it; documents whose upper bound reaches the new k-th partial sum remain. Phase 3
resolves their scores exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import shards
from .scratch import pick, table


@dataclass(frozen=True)
class Search:
    """``k``: documents a query; ``k1``, ``b``: of BM25; ``unit``: scores are whole
    multiples of one over this, so that sums do not depend on their order."""

    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    unit: int = 10_000


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query, term)``: the distinct words (hashed) of every query."""

    def run(batches):
        for b in batches:
            ids, texts = K.column(b, "item_id"), [t or "" for t in K.column(b, "text")]
            for at, part in K.chunks(texts):
                h, row, _, _ = K.words(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[at + r] for r in row.tolist()], pa.int64()), pa.array(h.astype(np.int64))], ["query", "term"]
                )

    return queries.filter("item_id is not null").mapInArrow(run, "query long, term long").distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, doc_id, tf, dl)`` of the given terms in every document with an id and at
    least one word; term 0 stands for the document itself (``dl`` words).

    The distinct terms of the queries are mapped by the workers as one array sorted by
    hash (see :mod:`sparkloom.llm.shards`), whatever their number.
    """
    made = shards.write(terms.select(F.lit(0).alias("g"), F.col("term").alias("code"), F.lit(0.0).cast("float").alias("v")).distinct(), 1)

    def run(batches):
        (index,) = shards.opened(made)
        for b in batches:
            ids, texts = np.array(K.column(b, "doc_id"), np.int64), [t or "" for t in K.column(b, "text")]
            for at, part in K.chunks(texts):
                h, row, _, _ = K.words(part)
                if not len(h):
                    continue
                dl = np.bincount(row, minlength=len(part))
                pos = index.find(h)
                hit = pos >= 0
                own, t = row[hit], h[hit]
                o = np.lexsort((t, own))
                own, t = own[o], t[o]
                at0 = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (own[1:] != own[:-1])])) if len(t) else o
                r, t, tf = own[at0], t[at0].astype(np.int64), np.diff(np.append(at0, len(own)))
                some = np.flatnonzero(dl)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([t, np.zeros(len(some), np.int64)])),
                        pa.array(ids[at + np.concatenate([r, some])]),
                        pa.array(np.concatenate([tf, np.ones(len(some), np.int64)]).astype(np.int32)),
                        pa.array(np.concatenate([dl[r], dl[some]]).astype(np.int32)),
                    ],
                    ["term", "doc_id", "tf", "dl"],
                )

    return docs.filter("doc_id is not null").mapInArrow(run, "term long, doc_id long, tf int, dl int")


def weight(n: Column, df: Column, p: Search) -> Column:
    """Inverse document frequency in whole thousandths."""
    return F.round(1000 * F.log(1 + (n - df + 0.5) / (df + 0.5))).cast("long")


def share(tf: Column, dl: Column, mean: Column, p: Search) -> Column:
    """Saturated term frequency, whole multiples of ``1 / unit``."""
    return F.floor(p.unit * (tf * (p.k1 + 1)) / (tf + p.k1 * (1 - p.b + p.b * dl / mean))).cast("long")


def top(df: DataFrame, order: list[Column], k: int, by: str = "query") -> DataFrame:
    """The first k rows of each group; partitions are cut to k rows a group first."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, p: Search = Search()) -> DataFrame:
    """``item_id, doc_id, rank, score``: for every query the k documents of the highest
    BM25 score, exactly; ties go to the smaller id.

    Words are as in :func:`kernels.words`. Null and empty texts are in no list, and null
    or empty queries have no rows; a query that fewer than k documents share a word with
    has that many. Rows that repeat an id and a text count once as a document; rows
    that repeat an id with other texts are one document with the words of all. A word
    that (nearly) all documents have weighs nothing, but its documents count. Texts are
    read wholly, other columns left aside. Empty tables give an empty result.
    """
    q = table(query_terms(pick(queries, item_id="long", text="string")), "queries")
    d = pick(docs, doc_id="long", text="string")
    raw = table(postings(d, q), "postings")
    stats = raw.filter("term = 0").agg(F.countDistinct("doc_id").alias("n"), F.sum("dl").alias("words"), F.count(F.lit(1)).alias("rows")).first()
    if not stats.n:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long, rank int, score long")
    lists = raw.filter("term <> 0")
    if stats.rows != stats.n:  # ids repeat
        lists = d.filter("doc_id is not null and text is not null").distinct()
        raw = table(postings(lists, q), "postings")
        length = raw.filter("term = 0").groupBy("doc_id").agg(F.sum("dl").cast("int").alias("dl"))
        stats = length.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).first()
        lists = raw.filter("term <> 0").groupBy("term", "doc_id").agg(F.sum("tf").cast("int").alias("tf")).join(length, "doc_id")
    mean = stats.words / stats.n
    df = lists.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", weight(F.lit(stats.n), F.col("df"), p).alias("idf"))
    terms = table(q.join(idf, "term"), "terms")  # a row a query and term: the queries' size
    m = terms.groupBy("query").agg(F.count(F.lit(1)).alias("m"))
    lists = lists.select("term", "doc_id", share(F.col("tf"), F.col("dl"), F.lit(mean), p).alias("s"))
    by_score = [F.desc("score"), F.asc("doc_id")]

    # phase 1: each list's head; a term's order is the same in all queries that have it
    heads = top(lists, [F.desc("s"), F.asc("doc_id")], p.k, by="term").select("term", "doc_id", "s")
    part = heads.join(terms, "term").groupBy("query", "doc_id").agg(F.sum(F.col("s") * F.col("idf")).alias("score"))
    kth = top(part, by_score, p.k).groupBy("query").agg(F.when(F.count(F.lit(1)) >= p.k, F.min("score")).otherwise(F.lit(0)).alias("low"))
    cut = table(terms.join(m.join(kth, "query"), "query").withColumn("cut", F.col("low") / F.col("m")), "cutoffs")

    # phase 2: all entries that reach the cutoff, by the least s that any query needs
    # a term of weight 0 reaches the cutoff with all its entries or with none
    reach = F.when(F.col("idf") > 0, F.col("cut") / F.col("idf")).when(F.col("cut") <= 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    need = cut.groupBy("term").agg(F.min(reach).alias("least"))
    seen = lists.join(need, "term").filter(F.col("s") >= F.col("least")).select("term", "doc_id", "s")
    seen = seen.join(cut.select("query", "term", "idf", "cut", "m"), "term").filter(F.col("s") * F.col("idf") >= F.col("cut"))
    part = table(
        seen.groupBy("query", "doc_id").agg(
            F.sum(F.col("s") * F.col("idf")).alias("score"), (F.first("m") - F.count(F.lit(1))).alias("unseen"), F.first("cut").alias("cut")
        ),
        "partial",
    )
    kth = top(part, by_score, p.k).groupBy("query").agg(F.when(F.count(F.lit(1)) >= p.k, F.min("score")).otherwise(F.lit(0)).alias("low"))
    left = table(part.join(kth, "query").filter(F.col("score") + F.col("unseen") * F.col("cut") >= F.col("low")).select("query", "doc_id"), "remaining")

    # phase 3: the remaining documents' exact scores
    rows = lists.join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    exact = rows.join(terms, "term").join(left, ["query", "doc_id"]).groupBy("query", "doc_id").agg(F.sum(F.col("s") * F.col("idf")).alias("score"))
    return top(exact, by_score, p.k).select(F.col("query").alias("item_id"), "doc_id", F.col("rank").cast("int").alias("rank"), "score")


def sql(p: Search = Search()) -> str:
    """The same search in DuckDB SQL, without phases."""
    return f"""
with words as (
  select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from words group by all),
dl as (select doc_id, sum(tf) as dl from tf group by doc_id),
st as (select count(*) as n, sum(dl)::double / count(*) as mean from dl),
q as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\p{{M}}]+')) as term from benchmark),
df as (select term, count(*) as df from tf where term in (select term from q) group by term),
idf as (select term, round(1000 * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)))::bigint as idf from df, st),
s as (
  select item_id, tf.doc_id, sum(idf * floor({p.unit} * (tf * ({p.k1}::double + 1)) / (tf + {p.k1}::double * (1 - {p.b}::double + {p.b}::double * dl / mean)))::bigint)::bigint as score
  from q join tf using (term) join idf using (term) join dl on dl.doc_id = tf.doc_id, st group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s)
select item_id, doc_id, rank, score from r where rank <= {p.k}"""
