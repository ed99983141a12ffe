"""Hash arrays larger than memory: files in the shared folder, mapped by every worker.

Spark writes the entries in shards of ascending hashes. The first worker that needs
them lays them out as one sorted array a group, shard by shard; the others wait and map
the files, so that a host holds one copy, in its page cache, whatever the size. Where
the shared folder is no mounted one, executors fetch the shards and lay them out locally.
"""

from __future__ import annotations

import fcntl
import json
from functools import lru_cache
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import store

BITS = 6  # 64 shards
STEP = 1 << 20


def _shared(df: DataFrame, name: str, by: str | None = None) -> str:
    """The folder of ``df``, which executors can read or, failing that, are sent."""
    path = store(df, name, by)
    if urlparse(path).scheme not in ("", "file"):
        df.sparkSession.sparkContext.addFile(path, recursive=True)
    return path


def _laid_out(path: str, make, *args) -> Path:
    """The folder of arrays that ``make(source, to, *args)`` makes once a host."""
    u = urlparse(path)
    source = Path(unquote(u.path)) if u.scheme in ("", "file") else Path(SparkFiles.get(u.path.rpartition("/")[2]))
    to = source / "_arrays"
    to.mkdir(exist_ok=True)
    with (to / "lock").open("w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not (to / "done").exists():
            make(source, to, *args)
            (to / "done").touch()
    return to


def write(entries: DataFrame, groups: int) -> str:
    """The folder of the shards of ``(g, code, v)``: group, 64-bit key, value."""

    def run(batches):
        for b in batches:
            h = K.mix(b.column("code").to_numpy(zero_copy_only=False).astype(np.uint64))
            shard = pa.array((h >> np.uint64(64 - BITS)).astype(np.int32))
            signed = pa.array((h ^ np.uint64(1 << 63)).view(np.int64))  # sorts as h does
            yield pa.RecordBatch.from_arrays([shard, b.column("g"), signed, b.column("v")], ["shard", "g", "h", "v"])

    rows = entries.select(F.col("g").cast("int").alias("g"), "code", "v").mapInArrow(run, "shard int, g int, h long, v float")
    return json.dumps([_shared(rows.repartition("shard").sortWithinPartitions("shard", "g", "h"), "model", by="shard"), groups])


class Mapped(K.HashArray):
    """A group of mapped files."""

    def __init__(self, h: np.ndarray, v: np.ndarray, first: np.ndarray, bits: int):
        self.h, self.v, self.dir, self.shift = h, v, first, np.uint64(64 - bits)


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _lay_out(source: Path, to: Path, groups: int) -> None:
    parts = [f for k in range(1 << BITS) for f in sorted(source.glob(f"shard={k}/*.parquet"))]
    size = np.zeros(groups, np.int64)
    for f in parts:
        for b in pq.ParquetFile(f).iter_batches(STEP, columns=["g"]):
            size += np.bincount(b.column(0).to_numpy(), minlength=groups)
    at = np.concatenate([[0], np.cumsum(size + 1)])
    firsts = np.concatenate([[0], np.cumsum([(1 << _bits(n)) + 1 for n in size])])
    h = np.memmap(to / "h", np.uint64, "w+", shape=int(at[-1]))
    v = np.memmap(to / "v", np.float32, "w+", shape=int(at[-1]))
    d = np.memmap(to / "d", np.int64, "w+", shape=int(firsts[-1]))
    free = at[:-1].copy()
    for f in parts:
        for b in pq.ParquetFile(f).iter_batches(STEP, columns=["g", "h", "v"]):
            g, x, y = (c.to_numpy() for c in b.columns)
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
            for a, e in zip(cut, [*cut[1:], len(g)]):
                k = free[g[a]]
                h[k : k + e - a] = x[a:e].view(np.uint64) ^ np.uint64(1 << 63)
                v[k : k + e - a] = y[a:e]
                free[g[a]] += e - a
    for i in range(groups):
        own, bits = np.asarray(h[at[i] : at[i + 1] - 1]), _bits(size[i])
        for k in range(0, 1 << bits, STEP):
            want = np.arange(k, min(k + STEP, 1 << bits), dtype=np.uint64) << np.uint64(64 - bits)
            d[firsts[i] + k : firsts[i] + k + len(want)] = np.searchsorted(own, want)
        d[firsts[i] + (1 << bits)] = size[i]
        h[at[i + 1] - 1], v[at[i + 1] - 1] = np.uint64(0xFFFFFFFFFFFFFFFF), 0
    for x in (h, v, d):
        x.flush()
    (to / "sizes").write_text(json.dumps(size.tolist()))


@lru_cache(1)
def opened(made: str) -> list[Mapped]:
    """The groups of a folder that :func:`write` returned."""
    if not made:
        return []
    path, groups = json.loads(made)
    to = _laid_out(path, _lay_out, groups)
    size = json.loads((to / "sizes").read_text())
    h, v, d = (np.asarray(np.memmap(to / n, t, "r")) for n, t in (("h", np.uint64), ("v", np.float32), ("d", np.int64)))
    out, a, f = [], 0, 0
    for n in size:
        bits = _bits(n)
        out.append(Mapped(h[a : a + n + 1], v[a : a + n + 1], d[f : f + (1 << bits) + 1], bits))
        a, f = a + n + 1, f + (1 << bits) + 1
    return out


def write_rows(entries: DataFrame, rows: int, words: int, bits: int) -> str:
    """The folder of a dense array ``[words, rows]`` of ``bits`` bits an entry, zero but
    for the entries ``(w, at, v)``, of which no two have one place."""
    return json.dumps([_shared(entries.select(F.col("w").cast("int").alias("w"), "at", "v"), "rows"), rows, words, bits])


def _fill(source: Path, to: Path, rows: int, words: int, bits: int) -> None:
    out = np.memmap(to / "rows", f"u{bits // 8}", "w+", shape=(words, rows))
    for f in sorted(source.glob("*.parquet")):
        for b in pq.ParquetFile(f).iter_batches(STEP, columns=["w", "at", "v"]):
            w, at, v = (c.to_numpy() for c in b.columns)
            out[w, at] = v.view(np.uint64).astype(out.dtype)
    out.flush()


@lru_cache(1)
def opened_rows(made: str) -> np.ndarray:
    """The array of a folder that :func:`write_rows` returned."""
    path, rows, words, bits = json.loads(made)
    to = _laid_out(path, _fill, rows, words, bits)
    return np.asarray(np.memmap(to / "rows", f"u{bits // 8}", "r", shape=(words, rows)))


def write_order(entries: DataFrame) -> str:
    """The folder of the rows of some 64-bit numbers, in ascending order."""
    names = entries.columns
    return json.dumps([_shared(entries.orderBy(*names), "order"), names])


def _line_up(source: Path, to: Path, names: list[str]) -> None:
    for n in names:
        with (to / n).open("wb") as out:
            for f in sorted(source.glob("*.parquet")):  # a global sort numbers its parts in order
                for b in pq.ParquetFile(f).iter_batches(STEP, columns=[n]):
                    out.write(b.column(0).to_numpy().astype(np.int64).tobytes())


@lru_cache(1)
def opened_order(made: str) -> tuple[np.ndarray, ...]:
    """The columns of a folder that :func:`write_order` returned."""
    path, names = json.loads(made)
    to = _laid_out(path, _line_up, names)
    return tuple(np.asarray(np.memmap(to / n, np.int64, "r")) if (to / n).stat().st_size else np.zeros(0, np.int64) for n in names)
