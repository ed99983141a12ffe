"""Sessions, and shipping this package to the workers."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: list[tuple[SparkSession, str]] = []


def build_session(app: str = "sparkloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on and UTC time; the master and the number of
    shuffle partitions are the cluster's own unless given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def _zipped() -> bytes:
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in {".py", ".json", ".csv", ".txt"}:
                z.write(p, p.relative_to(root.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once an application, so that Python
    workers can import them where the package is not installed. The archive lies in the
    shared folder (see :func:`shared_dir`)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        path = f"{shared_dir(spark)}/sparkloom/{sc.applicationId}-{uuid.uuid4().hex}/sparkloom_src.zip"
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(_zipped()))
        out.close()
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where none is set, a
    local one, which there may be only without a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def temporary(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which is removed when the driver's interpreter ends."""
    path = f"{shared_dir(ship(spark))}/{kind}/{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and reread: its lineage is cut, and readers take
    the columns that they need."""
    path = temporary(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _folders:
        try:
            sc = spark.sparkContext
            if sc._jsc is None:
                return
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already; the folder's owner then cleans it
            return
