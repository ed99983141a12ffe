"""Tables and databases as graphs: Parquet, DuckDB files, JDBC, Neo4j, ArangoDB."""

from __future__ import annotations

import os
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.catalog import DEFAULT_CATEGORY
from ..kg import KG
from ..operators.filters import Filters, sql_where
from ..operators.normalize import edge_key
from ..operators.store import first_records
from ..session import stored
from .common import ReadOptions, finish, with_seq


def load_parquet(spark: SparkSession, nodes: str, edges: str, o: ReadOptions | None = None, name: str = "graph") -> KG:
    """Parquet tables, typed already: without options they are taken as they are, and
    filters on them reach the scan."""
    n, e = spark.read.parquet(nodes), spark.read.parquet(edges)
    if o is None:
        return KG(n, e, name) if "edge_key" in e.columns else KG(n, e.withColumn("edge_key", edge_key()), name, ("edge_key",))
    return finish(with_seq(n), with_seq(e), o, name, spark)


def _duck(path: str, memory: str = "500MB"):
    """A file opened for reading, with one thread and bounded memory: tasks share a host."""
    import duckdb

    return duckdb.connect(path, read_only=True, config={"threads": 1, "memory_limit": memory})


def _duck_scan(spark: SparkSession, path: str, table: str, where: str, page: int) -> DataFrame:
    """One table of a DuckDB file that every executor can open, a range of rows a task; or
    of a folder of such files, whose rows follow each other in the order of their names."""
    paths, ranges, schema = part_files(path, table, ".duckdb"), [], None
    for k, p in enumerate(paths):
        with _duck(p) as c:
            if (table,) not in c.execute("select table_name from information_schema.tables").fetchall():
                raise ValueError(f"{p} has no table {table!r}")
            n = c.execute(f'select coalesce(max(rowid), -1) + 1 from "{table}"').fetchall()[0][0]
            if schema is None:
                arrow = c.sql(f'select * from "{table}" limit 0').to_arrow_table()
                names, schema = arrow.column_names, from_arrow_schema(arrow.schema).add("seq", "long")
        ranges += [(k, lo, min(lo + page * 20, n)) for lo in range(0, n, page * 20)]

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for i in b.column(0).to_pylist():
                k, lo, hi = ranges[i]
                with _duck(paths[k]) as c:
                    for at in range(lo, hi, page):
                        cond = f"rowid >= {at} and rowid < {min(at + page, hi)}" + (f" and {where}" if where else "")
                        for r in c.sql(f'select *, rowid + {k << 40} as seq from "{table}" where {cond}').to_arrow_table().to_batches():
                            yield pa.RecordBatch.from_arrays(r.columns, [*names, "seq"])

    return spark.range(0, len(ranges), numPartitions=max(1, min(len(ranges), 10_000))).mapInArrow(read, schema)


def load_duckdb(spark: SparkSession, path: str, filters: Filters | None = None, start: int | None = None, end: int | None = None, page: int = 50_000, name: str = "graph") -> KG:
    """Tables ``nodes`` and ``edges`` of a DuckDB file, or of a folder of such files (see
    ``write_duckdb``); filters run in the database.

    The first record of a node id counts. Records have no import typing. ``start`` and
    ``end`` cut the stream of nodes, then edges, in row order.
    """
    f = filters or Filters()
    nodes = first_records(_duck_scan(spark, path, "nodes", sql_where(f.nodes), page), ("id",), "seq", keep=True)
    if "category" not in nodes.columns:
        nodes = nodes.withColumn("category", F.array(F.lit(DEFAULT_CATEGORY)))
    e = {k: v for k, v in f.edges.items() if k not in ("subject_category", "object_category")}
    edges = _duck_scan(spark, path, "edges", sql_where(e), page).withColumn("edge_key", edge_key())
    edges = edges.withColumn("id", F.coalesce("id", "edge_key") if "id" in edges.columns else F.col("edge_key"))
    kg = KG(nodes, edges, name)
    if filters:
        kg = Filters({}, f.edges).apply(kg)
    if start is not None or end is not None:
        kg = sliced(kg, start or 0, end)
    return kg


def sliced(kg: KG, start: int, end: int | None) -> KG:
    """Records ``start`` to ``end`` (exclusive) of the nodes, then the edges, in the order of
    ``seq``, and of the key where that is equal.

    Rows are numbered by the counts of ranges before theirs, so that no task sorts all."""
    nodes = numbered(kg.nodes, ["seq", "id"])
    n = nodes.count()
    edges = numbered(kg.edges, ["seq", "edge_key"])
    cut = lambda d, lo, hi: d.filter((F.col("_row") >= lo) & (F.lit(True) if hi is None else F.col("_row") < hi)).drop("_row")
    return kg.with_(nodes=cut(nodes, start, end), edges=cut(edges, start - n, None if end is None else end - n))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with its row number ``_row`` from 0 in the order of those columns that it has."""
    order = [c for c in order if c in df.columns]
    spread = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")  # read twice, with one division into ranges
    part = F.shiftright("_at", 33)
    counts = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # a row a partition
    base, at = [], 0
    for c in counts:
        base.append((c["_part"], at))
        at += c.n
    if not base:
        return df.withColumn("_row", F.lit(0).cast("long"))
    table = F.broadcast(df.sparkSession.createDataFrame(base, "_part long, _base long"))
    return spread.withColumn("_part", part).join(table, "_part").withColumn("_row", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_at")


def part_files(path: str, table: str, suffix: str) -> list[str]:
    """The files of one table: of a folder those of its name in order, else the path itself."""
    if not os.path.isdir(path):
        return [path]
    found = sorted(f for f in os.listdir(path) if f.startswith(f"{table}-") and f.endswith(suffix))
    if not found:
        raise ValueError(f"{path} has no table {table!r}")
    return [f"{path}/{f}" for f in found]


def load_sqlite(spark: SparkSession, path: str, nodes: str = "nodes", edges: str = "edges", o: ReadOptions = ReadOptions(delimiter=None), name: str = "graph") -> KG:
    """Two tables of an SQLite file, each streamed by one task that can open it; or of a
    folder of such files (see ``write_sqlite_parts``), a task a file."""
    import sqlite3

    def scan(table: str) -> DataFrame:
        paths = part_files(path, table, ".sqlite")
        con = sqlite3.connect(paths[0])
        names = [r[1] for r in con.execute(f'pragma table_info("{table}")')]
        con.close()

        def read(batches):
            import pyarrow as pa

            for b in batches:
                for i in b.column(0).to_pylist():
                    con = sqlite3.connect(paths[i])
                    cur = con.execute(f'select * from "{table}"')
                    while got := cur.fetchmany(20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*got)], names)
                    con.close()

        return with_seq(spark.range(0, len(paths), numPartitions=len(paths)).mapInArrow(read, ", ".join(f"`{n}` string" for n in names)))

    return finish(scan(nodes), scan(edges), o, name, spark)


def load_jdbc(spark: SparkSession, url: str, nodes: str = "nodes", edges: str = "edges", o: ReadOptions = ReadOptions(), name: str = "graph", **options: str) -> KG:
    """Two tables over JDBC; with ``partitionColumn`` and bounds the scan is parallel."""
    r = lambda t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load()
    return finish(with_seq(r(nodes)), with_seq(r(edges)), o, name, spark)


def _cypher(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cypher_nodes(filters: dict[str, str | Collection[str]] | None = None, skip: int | None = None, limit: int | None = None, count: bool = False) -> str:
    """A node query: labels are alternatives, other properties memberships."""
    filters = filters or {}
    tests = []
    if filters.get("category"):
        c = filters["category"]
        tests.append("(" + " OR ".join(f"n:`{x}`" for x in ([c] if isinstance(c, str) else sorted(c))) + ")")
    for k, v in sorted(filters.items()):
        if k != "category":
            values = [v] if isinstance(v, str) else sorted(v)
            tests.append("(" + " OR ".join(f"{_cypher(x)} IN n.`{k}`" if k == "provided_by" else f"n.`{k}` = {_cypher(x)}" for x in values) + ")")
    q = "MATCH (n)" + (" WHERE " + " AND ".join(tests) if tests else "")
    return q + (" RETURN COUNT(n) AS count" if count else " RETURN n" + _paging(skip, limit))


def cypher_edges(filters: dict[str, str | Collection[str]] | None = None, skip: int | None = None, limit: int | None = None, directed: bool = True, count: bool = False) -> str:
    """An edge query: types among the predicates, labels of the ends, memberships."""
    filters = filters or {}
    tests = []
    for k, v in sorted(filters.items()):
        values = [v] if isinstance(v, str) else sorted(v)
        if k == "predicate":
            tests.append(f"type(p) IN [{', '.join(map(_cypher, values))}]")
        elif k in ("subject_category", "object_category"):
            tests.append("(" + " OR ".join(f"{k[0]}:`{x}`" for x in values) + ")")
        else:
            tests.append("(" + " OR ".join(f"{_cypher(x)} IN p.`{k}`" if k.endswith("_source") or k == "provided_by" else f"p.`{k}` = {_cypher(x)}" for x in values) + ")")
    q = f"MATCH (s)-[p]-{'>' if directed else ''}(o)" + (" WHERE " + " AND ".join(tests) if tests else "")
    return q + (" RETURN COUNT(p) AS count" if count else " RETURN s, p, o" + _paging(skip, limit))


def _paging(skip: int | None, limit: int | None) -> str:
    return (f" SKIP {skip}" if skip else "") + (f" LIMIT {limit}" if limit else "")


def load_neo4j(spark: SparkSession, uri: str, user: str, password: str, filters: Filters | None = None, directed: bool = True, o: ReadOptions = ReadOptions(delimiter=None), name: str = "graph") -> KG:
    """A Neo4j database through its Spark connector, which must be on the class path.

    Every edge also brings its ends; undirected reading gives each edge both ways.
    """
    f = filters or Filters()
    r = lambda q: spark.read.format("org.neo4j.spark.DataSource").options(**{"url": uri, "authentication.basic.username": user, "authentication.basic.password": password, "query": q}).load()
    nodes = r(cypher_nodes(f.nodes)).select("n.*")
    e = r(cypher_edges(f.edges, directed=directed))
    ends = e.select("s.*").unionByName(e.select("o.*"), allowMissingColumns=True)
    edges = with_ends(e)
    nodes = nodes.unionByName(ends, allowMissingColumns=True).dropDuplicates(["id"])
    return finish(with_seq(nodes), with_seq(edges), o, name, spark)


def with_ends(rows: DataFrame) -> DataFrame:
    """Edges from rows ``s, p, o``: all properties of ``p``, between the ids of its ends."""
    own = [F.col(f"p.`{f.name}`").alias(f.name) for f in rows.schema["p"].dataType.fields if f.name not in ("subject", "object") and not f.name.startswith("<")]
    return rows.select(F.col("s.id").alias("subject"), F.col("o.id").alias("object"), *own)


def aql_filter(filters: dict[str, str | Collection[str]], var: str) -> str:
    """An AQL filter: list properties overlap, others are among the values."""
    quote = lambda v: '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    tests = []
    for k, v in sorted(filters.items()):
        values = "[" + ", ".join(map(quote, [v] if isinstance(v, str) else sorted(v))) + "]"
        if k in ("subject_category", "object_category"):
            tests.append(f"LENGTH(INTERSECTION({k.split('_')[0]}.category, {values})) > 0")
        elif k in ("category", "provided_by"):
            tests.append(f"LENGTH(INTERSECTION({var}.`{k}`, {values})) > 0")
        else:
            tests.append(f"{var}.`{k}` IN {values}")
    return "FILTER " + " AND ".join(tests) if tests else ""


def load_arango(nodes: DataFrame, edges: DataFrame, o: ReadOptions = ReadOptions(delimiter=None), name: str = "graph") -> KG:
    """Vertex and edge documents (from the Spark connector, or exported JSON Lines).

    An id is the given one, or ``collection:key``; edges without both ends are left out.
    Those are looked up in a task's part of the vertices, without sorting the edges.
    """
    cid = lambda c: F.replace(c, F.lit("/"), F.lit(":"))
    n = nodes.withColumn("id", F.coalesce("id", cid(F.col("_id"))) if "id" in nodes.columns else cid(F.col("_id")))
    look = n.select(F.col("_id").alias("k"), F.col("id").alias("v"))
    e = edges
    for end, col in (("subject", "_from"), ("object", "_to")):
        e = e.join(look.toDF("_k", "_v").hint("shuffle_hash"), F.col(col) == F.col("_k")).withColumn(end, F.col("_v")).drop("_k", "_v")
    drop = lambda d: d.drop("_id", "_key", "_rev", "_from", "_to")
    return finish(with_seq(drop(n)), with_seq(drop(e)), o, name, nodes.sparkSession)
