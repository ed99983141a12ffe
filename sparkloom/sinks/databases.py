"""Database writers: SQLite and JDBC tables, Neo4j, ArangoDB."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import NS
from ..functions.curie import prefix_of, reference_of, safe_key
from ..kg import KG
from ..operators.normalize import edge_key, sanitize_export
from .files import EDGE_ORDER, HIDDEN, NODE_ORDER, ordered


def write_sqlite(kg: KG, path: str, node_table: str = "nodes", edge_table: str = "edges", batch: int = 10_000, most: int = 50_000_000) -> str:
    """Two tables of text columns with indexes on node ids and on edges' ends.

    SQLite has one writer: rows stream through the driver a partition at a time. A graph
    of more than ``most`` records is refused; :func:`write_sqlite_parts` and
    :func:`write_jdbc` write those.
    """
    n = kg.nodes.count() + kg.edges.count()
    if n > most:
        raise ValueError(f"{n} records are too many for one SQLite writer (at most {most}); use write_sqlite_parts or write_jdbc")
    con = sqlite3.connect(path)
    try:
        for df, table, core, mark in ((kg.nodes, node_table, NODE_ORDER, ","), (kg.edges, edge_table, EDGE_ORDER, "|")):
            df = sanitize_export(df.drop(*HIDDEN), mark)
            names = ordered(df.columns, core)
            quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
            con.execute(f'drop table if exists "{table}"')
            con.execute(f'create table "{table}" ({", ".join(q + " text" for q in quoted.split(", "))})')
            insert = f'insert into "{table}" values ({", ".join("?" * len(names))})'
            rows: list[tuple] = []
            for r in df.select(*[F.col("`" + n + "`") for n in names]).toLocalIterator():
                rows.append(tuple(r))
                if len(rows) >= batch:
                    con.executemany(insert, rows)
                    rows.clear()
            con.executemany(insert, rows)
        con.execute(f'create index if not exists "{node_table}_id" on "{node_table}" (id)')
        con.execute(f'create index if not exists "{edge_table}_spo" on "{edge_table}" (subject, predicate, object)')
        con.commit()
    finally:
        con.close()
    return path


def _part(folder: str, table: str, columns: list[str], index: str, make):
    """A function over batches that writes what a task holds into a database file of its
    own, named by its partition; a repeated attempt replaces the file."""

    def write(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        end = f"{folder}/{table}-{at:05d}{make.suffix}"
        loose, n = f"{end}.{uuid.uuid4().hex}", 0
        with make(loose, table, columns, index) as add:
            for b in batches:
                add(b)
                n += b.num_rows
        os.replace(loose, end)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([n], pa.int64())})

    return write


def _sqlite_part(path: str, table: str, columns: list[str], index: str):
    from contextlib import contextmanager

    @contextmanager
    def opened():
        con = sqlite3.connect(path)
        for p in ("journal_mode=off", "synchronous=off"):  # the file counts only once it is renamed
            con.execute(f"pragma {p}")
        quoted = ['"' + c.replace('"', '""') + '"' for c in columns]
        con.execute(f'create table "{table}" ({", ".join(q + " text" for q in quoted)})')
        insert = f'insert into "{table}" values ({", ".join("?" * len(columns))})'
        yield lambda b: con.executemany(insert, zip(*[c.to_pylist() for c in b.columns]))
        con.execute(f'create index "{table}_{index.split(",")[0]}" on "{table}" ({index})')
        con.commit()
        con.close()

    return opened()


_sqlite_part.suffix = ".sqlite"


def write_sqlite_parts(kg: KG, folder: str, node_table: str = "nodes", edge_table: str = "edges") -> str:
    """SQLite files of any number of records, ``<table>-<partition>.sqlite`` in a folder
    that all executors share: each task writes one, so that no record passes the driver.
    :func:`sparkloom.sources.databases.load_sqlite` reads the folder as one graph."""
    for df, table, core, mark, index in ((kg.nodes, node_table, NODE_ORDER, ",", "id"), (kg.edges, edge_table, EDGE_ORDER, "|", "subject, predicate, object")):
        df = sanitize_export(df.drop(*HIDDEN), mark)
        names = ordered(df.columns, core)
        df.select(*[F.col("`" + n + "`") for n in names]).mapInArrow(_part(folder, table, names, index, _sqlite_part), "rows long").agg(F.sum("rows")).first()
    return folder


def _duckdb_part(path: str, table: str, columns: list[str], index: str):
    from contextlib import contextmanager

    @contextmanager
    def opened():
        import duckdb
        import pyarrow as pa

        with duckdb.connect(path, config={"threads": 1, "memory_limit": "500MB"}) as c:
            made = False

            def add(b):
                nonlocal made
                c.register("batch", pa.Table.from_batches([b]))
                c.execute(f'insert into "{table}" select * from batch' if made else f'create table "{table}" as select * from batch')
                c.unregister("batch")
                made = True

            yield add

    return opened()


_duckdb_part.suffix = ".duckdb"


def write_duckdb(kg: KG, folder: str, node_order: tuple[str, ...] = ("id",), edge_order: tuple[str, ...] = ("subject", "predicate", "object")) -> str:
    """DuckDB files ``nodes-<partition>.duckdb`` and ``edges-<partition>.duckdb`` in a folder
    that all executors share, typed as the columns are. Files, and rows in them, follow the
    given orders; each is written by a task."""
    for df, table, order in ((kg.nodes, "nodes", node_order), (kg.edges, "edges", edge_order)):
        out = df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*HIDDEN)
        out.mapInArrow(_part(folder, table, out.columns, "", _duckdb_part), "rows long").agg(F.sum("rows")).first()
    return folder


def write_jdbc(kg: KG, url: str, nodes: str = "nodes", edges: str = "edges", **options: str) -> None:
    """Two tables over JDBC, written by all tasks."""
    for df, table, mark in ((kg.nodes, nodes, ","), (kg.edges, edges, "|")):
        sanitize_export(df.drop(*HIDDEN), mark).write.format("jdbc").options(url=url, dbtable=table, **options).mode("overwrite").save()


def label(category: str) -> str:
    """A category as a quoted label."""
    return "`" + category.replace("`", "") + "`"


def cypher_constraint(category: str) -> str:
    return f"CREATE CONSTRAINT IF NOT EXISTS FOR (n:{label(category)}) REQUIRE n.id IS UNIQUE"


def cypher_node_batch(category: str) -> str:
    """Upsert of a batch of nodes of one category."""
    return f"UNWIND $nodes AS node MERGE (n:`{NS}:NamedThing` {{id: node.id}}) ON CREATE SET n += node, n:{label(category)} ON MATCH SET n += node, n:{label(category)}"


def cypher_edge_batch(predicate: str) -> str:
    """Upsert of a batch of edges of one predicate."""
    return (
        f"UNWIND $edges AS edge MATCH (s:`{NS}:NamedThing` {{id: edge.subject}}), (o:`{NS}:NamedThing` {{id: edge.object}}) "
        f"MERGE (s)-[r:{label(predicate)}]->(o) SET r += edge"
    )


def write_neo4j(kg: KG, uri: str, user: str, password: str, most: int = 2000) -> None:
    """Through the Spark connector, which must be on the class path: nodes by id, then
    the edges of each predicate, one job each, since the connector takes the type of a
    relationship as an option. Predicates are those of a model, a few hundred at most;
    more than ``most`` are refused."""
    auth = {"url": uri, "authentication.basic.username": user, "authentication.basic.password": password}
    w = lambda df, **o: df.write.format("org.neo4j.spark.DataSource").mode("Overwrite").options(**auth, **o).save()
    w(kg.nodes.drop(*HIDDEN), labels=f":`{NS}:NamedThing`", **{"node.keys": "id"})
    kinds = [r[0] for r in kg.edges.select("predicate").distinct().limit(most + 1).collect()]
    if len(kinds) > most:
        raise ValueError(f"more than {most} predicates")
    for p in kinds:
        w(
            kg.edges.filter(F.col("predicate") == p).drop(*HIDDEN), relationship=p,
            **{"relationship.save.strategy": "keys", "relationship.source.labels": f":`{NS}:NamedThing`", "relationship.source.node.keys": "subject:id", "relationship.target.labels": f":`{NS}:NamedThing`", "relationship.target.node.keys": "object:id"},
        )


def arango_documents(kg: KG, routing: bool = True, nodes: str = "nodes", edges: str = "edges") -> tuple[DataFrame, DataFrame]:
    """Vertex documents with ``_collection, _key`` and edge documents with ``_from, _to``
    besides. With ``routing`` a collection is named by the ids' prefixes."""
    key = lambda c: safe_key(F.coalesce(reference_of(c), F.col(c)))
    home = lambda c: F.coalesce(prefix_of(c), F.lit(nodes)) if routing else F.lit(nodes)
    n = kg.nodes.drop(*HIDDEN).withColumn("_collection", home("id")).withColumn("_key", key("id"))
    e = kg.edges.drop(*HIDDEN)
    e = e.withColumn("_collection", F.concat_ws("-", home("subject"), home("object")) if routing else F.lit(edges)).withColumn("_key", safe_key(edge_key()))
    for end, c in (("_from", "subject"), ("_to", "object")):
        e = e.withColumn(end, F.concat_ws("/", home(c), key(c)))
    return n, e


def write_arango(kg: KG, base: str, routing: bool = True) -> tuple[str, str]:
    """Documents as JSON Lines in a folder a collection, ready for import."""
    n, e = arango_documents(kg, routing)
    n.write.mode("overwrite").partitionBy("_collection").json(f"{base}_vertices")
    e.write.mode("overwrite").partitionBy("_collection").json(f"{base}_edges")
    return f"{base}_vertices", f"{base}_edges"
