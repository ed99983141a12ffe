"""The children of the root of one large XML document, parsed by many tasks.

A document is cut into blocks of bytes, wherever those end. A first pass says of every
block how it changes the nesting, for each way in which it may begin (among tags, or within
a comment, a CDATA section or an instruction); the driver adds these up (a row a block). The
document then falls into pieces, each from the first child that opens in a block to the
first one of a later block, and a second pass parses every piece as a document of its own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from xml.parsers import expat
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession

from .documents import local

BLOCK = 8 << 20
CHUNK = 1 << 20
#: A tag: a closing one (1), what opens a section of other text (2), one without content (3),
#: or else an opening one. No tag holds a ``<``, so that none is mistaken from within another.
TAG = re.compile(rb"""<(?:(/)[^<>]*+>|(!--|!\[CDATA\[|\?)|[^<>"'/!?\s](?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+(?:(?<=/)()>|>))""")
CLOSE = {b"!--": b"-->", b"![CDATA[": b"]]>", b"?": b"?>"}
LEAD = 2  # bytes before a block in which the end of a section may begin
REACH = 9  # bytes of a block, at most, that what opens a section may take up


def head(path: str) -> bytes | None:
    """A document up to its root's opening tag, which is included; None for one that is not
    to be cut: malformed before that, or in an encoding that writes ``<`` in another way."""
    at: list[int] = []
    p = expat.ParserCreate()

    def start(name, attributes):
        if not at:
            at.append(p.CurrentByteIndex)

    p.StartElementHandler = start
    data = b""
    with open(path, "rb") as f:
        while not at and (got := f.read(1 << 16)):
            data += got
            try:
                p.Parse(got, False)
            except expat.ExpatError:
                if not at:
                    return None
    m = TAG.match(data, at[0]) if at and re.match(rb"(?:\xef\xbb\xbf)?\s*<[^\0]", data) else None
    return data[: m.end()] if m and m.lastindex is None else None


def _block(f, at: int, size: int) -> bytes:
    """A block with ``LEAD`` bytes before it and all that belongs to tags that begin in it,
    which is at most what comes before the next ``<``."""
    f.seek(at - LEAD)
    data = f.read(LEAD + size)
    while got := f.read(1 << 16):
        k = got.find(b"<")
        data += got if k < 0 else got[:k]
        if k >= 0:
            break
    return data


def _scan(data: bytes, at: int, stop: int) -> dict:
    """What the tags that begin from ``at`` to ``stop`` do: the change of the nesting, for
    each level up to that of the start where the first element of it opens, and how the next
    block begins: the section that it is in, and where its text starts."""
    depth, first, pos = 0, {}, at
    while True:
        for m in TAG.finditer(data, pos):
            if m.start() >= stop:
                break
            kind = m.lastindex
            if kind == 1:
                depth -= 1
            elif kind == 2:
                close = CLOSE[m[2]]
                over = data.find(close, m.end())
                if over < 0 or over + len(close) > stop:
                    return {"change": depth, "first": first, "in": m[2].decode(), "from": max(m.end() - stop, -LEAD)}
                pos = over + len(close)
                break
            else:
                if depth <= 0 and depth not in first:
                    first[depth] = m.start() - LEAD
                if kind is None:
                    depth += 1
        else:
            break
        if m.start() >= stop:
            break
    return {"change": depth, "first": first, "in": "", "from": 0}


def shape(path: str, at: int, size: int) -> dict:
    """:func:`_scan` of a block for every way in which it may begin: ``""`` where it begins
    among tags, else the section and where its text starts."""
    with open(path, "rb") as f:
        data = _block(f, at, size)
    stop = min(LEAD + size, len(data))
    known: dict[int, dict] = {}
    out = {"": _scan(data, LEAD, stop)}
    for kind, close in CLOSE.items():
        k = data.find(close)
        for s in range(-LEAD, REACH):
            if 0 <= k < LEAD + s:
                k = data.find(close, LEAD + s)
            r = k + len(close)
            if k < 0 or r > stop:
                out[f"{kind.decode()} {s}"] = {"change": 0, "first": {}, "in": kind.decode(), "from": max(s - size, -LEAD)}
                continue
            if r not in known:
                known[r] = _scan(data, r, stop)
            out[f"{kind.decode()} {s}"] = known[r]
    return out


def bounds(shapes: list[dict], begin: int, size: int) -> list[int]:
    """Where the pieces of a document begin, whose blocks from ``begin`` have these shapes."""
    depth, state, out = 0, "", [begin]
    for i, x in enumerate(shapes):
        s = x[state]
        if i and (k := s["first"].get(str(-depth))) is not None:
            out.append(begin + i * size + k)
        depth += s["change"]
        state = f"{s['in']} {s['from']}" if s["in"] else ""
    if depth != -1 or state:
        raise ValueError("the document ends within an element")
    return out


def pieces(spark: SparkSession, path: str) -> tuple[bytes, list[tuple[int, int | None]]] | None:
    """The document's head and the bounds of its pieces; None if it is to be parsed whole,
    which holds for what is no plain file."""
    at = local(path)
    top = head(at) if at else None
    if top is None:
        return None
    begin, size = len(top), BLOCK
    n = max(1, -(-(os.path.getsize(at) - begin) // size))

    def shapes(batches):
        import pyarrow as pa

        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "s": [json.dumps(shape(at, begin + i * size, size))]})

    rows = sorted(spark.range(0, n, numPartitions=min(n, 10_000)).mapInArrow(shapes, "i long, s string").collect())
    starts = bounds([json.loads(r.s) for r in rows], begin, size)
    return top, list(zip(starts, [*starts[1:], None]))


def children(path: str, top: bytes, start: int, end: int | None) -> Iterator:
    """The root's children in a piece, each once it is whole."""
    import xml.etree.ElementTree as ET

    name = re.match(rb"<[^\s>]+", top[top.rindex(b"<") :])[0][1:]
    p = ET.XMLPullParser(("start", "end"))
    p.feed(top)
    depth, root = 0, None

    def got():
        nonlocal depth, root
        for event, e in p.read_events():
            if event == "start":
                root = e if root is None else root
                depth += 1
                continue
            depth -= 1
            if depth == 1:
                yield e
                root.clear()

    with open(path, "rb") as f:
        f.seek(start)
        while data := f.read(CHUNK if end is None else min(CHUNK, end - f.tell())):
            p.feed(data)
            yield from got()
    if end is not None:
        p.feed(b"</" + name + b">")
    p.close()
    yield from got()


def parsed(spark: SparkSession, path: str, parse, schema: str) -> DataFrame | None:
    """What ``parse`` makes of every piece's children: it gets them and a name of the piece,
    and yields batches. None if the document is to be parsed whole."""
    found = pieces(spark, path)
    if found is None:
        return None
    (top, at), where = found, local(path)

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from parse(children(where, top, *at[i]), f"{crc32(path.encode())}p{i}")

    return spark.range(0, len(at), numPartitions=min(len(at), 10_000)).mapInArrow(run, schema)
