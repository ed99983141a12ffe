"""TSV and CSV files, plain, compressed or in tar archives."""

from __future__ import annotations

import csv
import io
import os
import tarfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kg import KG
from ..session import stored
from .common import ReadOptions, finish, role, with_seq

SEPARATOR = {"tsv": "\t", "csv": ","}


def read_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """One delimited file, every cell a string. TSV has no quoting; CSV cells may span
    lines in quotes, and then the file is read by one task."""
    r = spark.read.option("header", True).option("inferSchema", False).option("sep", SEPARATOR[fmt]).option("mode", "PERMISSIVE")
    if fmt == "tsv":
        return r.option("quote", "").csv(path)
    return r.option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def lines_with(spark: SparkSession, path: str, table: DataFrame, delimiter: str | None) -> DataFrame | None:
    """The rows of a TSV file, read as ``table``, that hold the delimiter: its lines are
    searched whole, and only those found are parsed. None where the header holds it."""
    if not delimiter or any(delimiter in c for c in table.columns):
        return None
    found = spark.read.text(path).filter(F.col("value").contains(delimiter))
    text = getattr(found._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    r = spark.read.schema(table.schema).option("sep", SEPARATOR["tsv"]).option("quote", "")
    return DataFrame(r._jreader.csv(text), spark)


def read_archive(spark: SparkSession, path: str, fmt: str) -> dict[str, DataFrame]:
    """Nodes and edges of an archive (plain, gz or bz2), whatever the members' order.

    One task streams through it once and keeps the rows as a table; it holds some MB. A file
    that tasks cannot open comes whole as bytes."""
    own = path.removeprefix("file://").removeprefix("file:")
    own = own if os.path.isfile(own) else None

    def lines(f):
        """Lists of cells, a few MB at a time."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if fmt == "csv":
            rows = csv.reader(io.TextIOWrapper(f, "utf-8", newline=""))
            while part := [x for _, x in zip(range(5000), rows)]:
                yield pa.array(part, pa.list_(pa.string()))
            return
        rest = b""
        while True:
            got = f.read(4 << 20)
            text = rest + got
            at = text.rfind(b"\n") + 1 if got else len(text)
            text, rest = text[:at], text[at:]
            if part := [x for x in text.decode("utf-8").replace("\r\n", "\n").split("\n") if x]:
                yield pc.split_pattern(pa.array(part, pa.string()), "\t")
            if not got:
                return

    def members(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column(0).to_pylist():
                with tarfile.open(own) if own else tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        r = role(m.name, fmt) if m.isfile() else None
                        at = 0
                        for cells in lines(tar.extractfile(m)) if r else ():
                            n = len(cells)
                            yield pa.RecordBatch.from_arrays([pa.array([r] * n), pa.array(range(at, at + n), pa.int64()), cells], ["role", "line", "cells"])
                            at += n

    schema = "role string, line long, cells array<string>"
    source = spark.range(0, 1, numPartitions=1) if own else spark.read.format("binaryFile").load(path).select("content")
    rows = stored(source.mapInArrow(members, schema), "archive")
    heads = {r.role: r.cells for r in rows.filter("line = 0").collect()}
    out = {}
    for r, head in heads.items():
        body = rows.filter((F.col("role") == r) & (F.col("line") > 0))
        cell = lambda i: F.when(F.try_element_at("cells", F.lit(i + 1)) != "", F.try_element_at("cells", F.lit(i + 1)))
        out[r] = body.select(*[cell(i).alias(h) for i, h in enumerate(head)], F.col("line").alias("seq"))
    return out


def load(spark: SparkSession, paths: str | list[str], fmt: str = "tsv", compression: str | None = None, o: ReadOptions = ReadOptions(), name: str = "graph") -> KG:
    """A graph from files whose names end in ``nodes.<fmt>`` and ``edges.<fmt>`` (others
    are left out) or from an archive of such."""
    parts: dict[str, DataFrame | None] = {"nodes": None, "edges": None}
    listed: dict[str, list[DataFrame | None]] = {}
    for rank, p in enumerate([paths] if isinstance(paths, str) else paths):
        if compression and compression.startswith("tar"):
            found = read_archive(spark, p, fmt)
        else:
            r = role(p, fmt)
            found = {}
            if r:
                table = read_table(spark, p, fmt)
                found[r] = with_seq(table, rank)
                listed.setdefault(r, []).append(lines_with(spark, p, table, o.delimiter) if fmt == "tsv" else None)
        for r, df in found.items():
            df = df.withColumn("seq", F.col("seq").cast(T.LongType()))
            parts[r] = df if parts[r] is None else parts[r].unionByName(df, allowMissingColumns=True)
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return finish(parts["nodes"], parts["edges"], o, name, spark, {r: reduce(union, ds) for r, ds in listed.items() if all(d is not None for d in ds)})
