"""Shared-folder tables that cut lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only when that is
unset and there is no cluster (tests, notebooks) is a local folder set instead.
"""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

_written: list[tuple[SparkSession, str]] = []


def store(df: DataFrame, name: str, by: str | None = None) -> str:
    """Write ``df`` to the shared folder as Parquet, in a folder for each value of ``by``
    if that is given, and return the full path.

    Unlike an executor-local copy, the files outlive lost executors. They are removed
    when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    _written.append((spark, path))
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as :func:`store` does and return the reread table."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            sc = spark.sparkContext
            if sc._jsc is None:
                return
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already; the folder's owner then cleans it
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names not yet used in ``df`` (compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """A column by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns of ``df`` cast to the given types; absent ones are null.

    Whatever else the table holds is dropped, so extra columns cannot clash with an
    operator's own.
    """
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[(col(have[n.lower()]) if n.lower() in have else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]
    )


def append(df: DataFrame, run, **kinds: str) -> DataFrame:
    """``df`` with columns that ``run`` appends to each Arrow batch.

    Columns pass through by position, whatever their names.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in plain.schema.fields])
    for i, t in enumerate(kinds.values()):
        schema = schema.add(T.StructType.fromDDL(f"x{i} {t}").fields[0])
    every = schema.fieldNames()

    def go(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *run(b)], every)

    return plain.mapInArrow(go, schema).toDF(*names, *kinds)
