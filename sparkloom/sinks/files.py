"""Writers: delimited text, JSON, JSON Lines, Parquet, N-Triples, TRAPI, archives.

Writers write folders of part files, one a task. Single documents (JSON, TRAPI, tar
archives) are joined through the file system by streaming the parts, never in memory.
"""

from __future__ import annotations

import csv
import gzip
import io
import os
import shutil
import tarfile
import tempfile
import time
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import DEFAULT_CATEGORY, NS
from ..functions.curie import expand, is_curie, is_iri
from ..kg import KG
from ..operators.normalize import col, edge_key, sanitize_export, used_properties
from ..sources.rdf import prefixes as rdf_prefixes

NODE_ORDER = "id category name description xref provided_by synonym exact_synonym broad_synonym narrow_synonym related_synonym".split()
EDGE_ORDER = "id subject predicate object category relation provided_by".split()
HIDDEN = ("seq", "edge_key")
SEPARATOR = {"tsv": "\t", "csv": ","}


def ordered(names: list[str], core: list[str]) -> list[str]:
    """Core columns first, then the others by name, then internal ones (``_...``)."""
    rest = sorted(n for n in names if n not in core)
    return [c for c in core if c in names] + [n for n in rest if not n.startswith("_")] + [n for n in rest if n.startswith("_")]


def _shown(df: DataFrame, names: list[str] | None) -> DataFrame:
    df = df.drop(*HIDDEN)
    if names is None:
        return df
    return df.select(*[col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def _writer(df: DataFrame, compression: str | None):
    w = df.write.mode("overwrite")
    return w.option("compression", compression) if compression else w


def write_delimited(kg: KG, base: str, fmt: str = "tsv", delimiter: str = "|", node_properties: list[str] | None = None, edge_properties: list[str] | None = None, compression: str | None = None, single: bool = False, header: bool = True, rows_a_file: int = 0) -> tuple[str, str]:
    """``<base>_nodes.<fmt>`` and ``<base>_edges.<fmt>`` with header lines. TSV cells are
    neither quoted nor escaped; tabs and line breaks are blanks already."""
    out = []
    for df, names, core, what in ((kg.nodes, node_properties, NODE_ORDER, "nodes"), (kg.edges, edge_properties, EDGE_ORDER, "edges")):
        df = sanitize_export(_shown(df, names), delimiter)
        df = df.select(*[col(c) for c in ordered(df.columns, core)])
        w = _writer(df.coalesce(1) if single else df, compression if compression in ("gzip", "bzip2") else None)
        w = w.option("header", header).option("maxRecordsPerFile", rows_a_file).option("sep", SEPARATOR[fmt]).option("emptyValue", "").option("nullValue", "")
        path = f"{base}_{what}.{fmt}"
        (w.option("quote", "").option("escapeQuotes", False) if fmt == "tsv" else w.option("quote", '"').option("escape", '"')).csv(path)
        out.append(path)
    return out[0], out[1]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The part files of a written folder, in order."""
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))


class _Joined:
    """Local files read one after the other, for ``tarfile``."""

    def __init__(self, head: bytes, paths: list[str]):
        self.now, self.paths = io.BytesIO(head), list(paths)

    def read(self, n: int) -> bytes:
        while not (got := self.now.read(n)) and self.paths:
            self.now = open(self.paths.pop(0), "rb")
        return got + (self.read(n - len(got)) if got and len(got) < n and self.paths else b"")


def _text_size(path: str) -> int:
    """Bytes of text of a gzip file: its trailer has them up to 4 GB, which less than 4 MB cannot hold."""
    if os.path.getsize(path) < 4 << 20:
        with open(path, "rb") as f:
            f.seek(-4, os.SEEK_END)
            return int.from_bytes(f.read(), "little")
    with gzip.open(path) as f:
        return sum(len(x) for x in iter(lambda: f.read(1 << 20), b""))


def write_archive(spark: SparkSession, kg: KG, path: str, fmt: str = "tsv", mode: str = "gz", scratch: str | None = None, most: int | None = None) -> str:
    """A tar archive of both tables on the driver's file system. A table of more than
    ``most`` bytes of text is refused, if that is given.

    Tasks write the tables' parts; of a gzip archive they also compress them, since gzip
    files one after the other are one gzip file, and the driver only copies."""
    base, gz = (scratch or path) + ".parts", mode == "gz"
    names = write_delimited(kg, base, fmt, compression="gzip" if gz else None, header=False, rows_a_file=400_000)
    pack = (lambda x: gzip.compress(x)) if gz else (lambda x: x)
    tar = None if gz else tarfile.open(path, f"w:{mode}" if mode else "w")
    with open(path, "wb") if gz else tar as out:
        for what, df, core, folder in (("nodes", kg.nodes, NODE_ORDER, names[0]), ("edges", kg.edges, EDGE_ORDER, names[1])):
            head = io.StringIO()
            columns = ordered(_shown(df, None).columns, core)
            csv.writer(head, lineterminator="\n").writerow(columns) if fmt == "csv" else head.write(SEPARATOR[fmt].join(columns) + "\n")
            head = head.getvalue().encode()
            with tempfile.TemporaryDirectory() as loose:
                local = []
                for i, part in enumerate(parts(spark, folder)):
                    if part.startswith("file:"):
                        local.append(part.removeprefix("file://").removeprefix("file:"))
                    else:
                        fs, p = _fs(spark, part)
                        local.append(f"{loose}/{i:05d}")
                        fs.copyToLocalFile(False, p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local[-1]}"), True)
                info = tarfile.TarInfo(f"{path.rsplit('/', 1)[-1].split('.')[0]}_{what}.{fmt}")
                info.size, info.mtime = len(head) + sum(_text_size(p) if gz else os.path.getsize(p) for p in local), int(time.time())
                if most is not None and info.size > most:
                    raise ValueError(f"the {what} are too large for an archive (at most {most} bytes)")
                if gz:
                    out.write(pack(info.tobuf(tarfile.GNU_FORMAT) + head))
                    for p in local:
                        with open(p, "rb") as f:
                            shutil.copyfileobj(f, out, 1 << 20)
                    out.write(pack(b"\0" * (-info.size % 512)))
                else:
                    tar.addfile(info, _Joined(head, local))
            fs, p = _fs(spark, folder)
            fs.delete(p, True)
        if gz:
            out.write(pack(b"\0" * 1024))
    return path


def write_jsonl(kg: KG, base: str, compression: str | None = None, node_properties: list[str] | None = None, edge_properties: list[str] | None = None, rows_a_file: int = 0) -> tuple[str, str]:
    """``<base>_nodes.jsonl`` and ``<base>_edges.jsonl``; nulls are left out. A compressed
    file is read by one task: ``rows_a_file`` bounds it."""
    for df, names, what in ((kg.nodes, node_properties, "nodes"), (kg.edges, edge_properties, "edges")):
        _writer(_shown(df, names), compression).option("maxRecordsPerFile", rows_a_file).json(f"{base}_{what}.jsonl")
    return f"{base}_nodes.jsonl", f"{base}_edges.jsonl"


def _append(spark: SparkSession, folder: str, out, skip: int = 0) -> None:
    """Stream the part files of a folder to an open file, without the first ``skip`` bytes
    of the text, and remove them."""
    for part in parts(spark, folder):
        fs, p = _fs(spark, part)
        if not fs.getFileStatus(p).getLen():
            continue
        stream = fs.open(p)
        while skip:
            stream.read()
            skip -= 1
        spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
        stream.close()
        fs.delete(p, False)  # so that the text lies on disk once
    fs, p = _fs(spark, folder)
    fs.delete(p, True)


def write_lines(spark: SparkSession, path: str, first: list[str], lines: DataFrame, last: list[str] = ()) -> str:
    """A text file of the given lines, in order: tasks write those of ``lines`` (``value``),
    and the driver streams their part files."""
    folder = f"{path}.parts"
    lines.select("value").write.mode("overwrite").text(folder)
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    write = lambda t: out.write(bytearray("".join(x + "\n" for x in t).encode()))
    write(first)
    _append(spark, folder, out)
    write(last)
    out.close()
    return path


def write_document(spark: SparkSession, sections: dict[str, DataFrame], path: str, opening: str, closing: str) -> str:
    """One JSON document of named arrays (or, for ``k``/``v`` rows, objects), streamed
    from the tasks' part files."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    write = lambda s: out.write(bytearray(s.encode()))
    write(opening)
    for i, (name, df) in enumerate(sections.items()):
        keyed = "k" in df.columns
        body = F.concat(F.lit('"'), F.regexp_replace("k", r'(["\\])', r"\\$1"), F.lit('":'), F.col("v")) if keyed else F.col("v")
        folder = f"{path}.{name}.parts"
        df.select(F.concat(F.lit(","), body).alias("value")).write.mode("overwrite").text(folder)
        write((", " if i else "") + f'"{name}": ' + ("{" if keyed else "["))
        _append(spark, folder, out, 1)  # without the first comma
        write("}" if keyed else "]")
    write(closing)
    out.close()
    return path


def write_json(spark: SparkSession, kg: KG, path: str) -> str:
    """``{"nodes": [...], "edges": [...]}``."""
    j = lambda df: df.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias("v"))
    return write_document(spark, {"nodes": j(_shown(kg.nodes, None)), "edges": j(_shown(kg.edges, None))}, path, "{", "}\n")


def write_parquet(kg: KG, base: str) -> tuple[str, str]:
    """``<base>_nodes.parquet`` and ``<base>_edges.parquet``, typed."""
    for df, what in ((kg.nodes, "nodes"), (kg.edges, "edges")):
        df.drop(*HIDDEN).write.mode("overwrite").option("compression", "zstd").parquet(f"{base}_{what}.parquet")
    return f"{base}_nodes.parquet", f"{base}_edges.parquet"


def write_null(kg: KG) -> None:
    """Run the plans and discard the rows."""
    kg.nodes.write.format("noop").mode("overwrite").save()
    kg.edges.write.format("noop").mode("overwrite").save()


def _uri(c: Column, px: dict[str, str]) -> Column:
    full = expand(c, px)
    bad = r"[<>\"{}|^`\\\x00-\x20]"
    plain = F.when(is_iri(full) | full.startswith("urn:uuid:"), full).otherwise(F.concat(F.lit("urn:x:"), F.url_encode(c)))
    return F.concat(F.lit("<"), F.regexp_replace(plain, bad, "_"), F.lit(">"))


def _literal(c: Column, kind: str | None = None) -> Column:
    e = F.regexp_replace(c, r'(["\\])', r"\\$1")
    e = F.regexp_replace(F.regexp_replace(F.regexp_replace(e, "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
    return F.concat(F.lit('"'), e, F.lit('"' + (f"^^<http://www.w3.org/2001/XMLSchema#{kind}>" if kind else "")))


XSD = {"boolean": "boolean", "bigint": "integer", "int": "integer", "double": "double", "float": "float"}


def _line(subject: Column, pred: Column, px: dict[str, str], uri: bool, kind: str | None, v: Column) -> Column:
    text = v.cast("string")
    obj = F.when(is_curie(text) | is_iri(text), _uri(text, px)).otherwise(_literal(text)) if uri else _literal(text, kind)
    return F.concat_ws(" ", subject, pred, obj, F.lit("."))


def _property_lines(df: DataFrame, subject: Column, names: list[str], px: dict[str, str], uris: frozenset[str]) -> Column:
    """An array of N-Triples lines, one for each value of each property."""
    lines = []
    for n in names:
        t = df.schema[n].dataType
        pred = _uri(F.lit(f"{NS}:{n}") if ":" not in n else F.lit(n), px)
        kind = XSD.get((t.elementType if isinstance(t, T.ArrayType) else t).simpleString())
        line = partial(_line, subject, pred, px, n in uris, kind)
        one = F.transform(F.filter(col(n), lambda x: x.isNotNull()), lambda v: line(v)) if isinstance(t, T.ArrayType) else F.when(col(n).isNotNull(), F.array(line(col(n))))
        lines.append(F.coalesce(one, F.array().cast("array<string>")))
    return F.flatten(F.array(*lines)) if lines else F.array().cast("array<string>")


URIS = frozenset(("category", "same_as", "xref", "type", "relation", "publications"))


def ntriples(kg: KG, reify_all: bool = False, prefixes: dict[str, str] | None = None) -> DataFrame:
    """``value``: the lines of the graph. An edge is a direct triple; with further
    properties, or always with ``reify_all``, also a reified association."""
    px = prefixes or rdf_prefixes()
    n, e = kg.nodes.drop(*HIDDEN), kg.edges.drop(*HIDDEN)
    nl = n.select(F.explode(_property_lines(n, _uri(F.col("id"), px), [c for c in n.columns if c != "id"], px, URIS)).alias("value"))
    s, p, o = (_uri(F.col(c), px) for c in ("subject", "predicate", "object"))
    direct = F.concat_ws(" ", s, p, o, F.lit("."))
    extra = [c for c in e.columns if c not in ("id", "subject", "predicate", "object")]
    has = F.lit(reify_all)
    for c in extra:
        has = has | col(c).isNotNull()
    me = _uri(F.coalesce("id", edge_key()) if "id" in e.columns else edge_key(), px)
    slot = lambda name, v: F.concat_ws(" ", me, _uri(F.lit(name), px), v, F.lit("."))
    kind = slot("rdf:type", _uri(F.lit(f"{NS}:Association"), px))
    body = F.concat(F.array(kind, slot(f"{NS}:subject", s), slot(f"{NS}:predicate", p), slot(f"{NS}:object", o)), _property_lines(e, me, extra, px, URIS))
    el = e.select(F.explode(F.concat(F.array(direct), F.when(has, body).otherwise(F.array().cast("array<string>")))).alias("value"))
    return nl.unionByName(el)


def write_ntriples(kg: KG, path: str, reify_all: bool = False, compression: str | None = None, prefixes: dict[str, str] | None = None) -> str:
    _writer(ntriples(kg, reify_all, prefixes), compression).text(path)
    return path


VALUE_TYPES = {"provided_by": f"{NS}:Agent", "xref": "EDAM:data_0896", "synonym": f"{NS}:Phenomenon", "description": f"{NS}:Phenomenon"}


def _json_value(df: DataFrame, n: str, listed: bool) -> Column:
    t, c = df.schema[n].dataType, col(n)
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    quoted = F.to_json(F.array(c))
    return quoted if listed else F.substring(quoted, 2, F.length(quoted) - 2)


def _attributes(df: DataFrame, skip: tuple[str, ...]) -> Column:
    parts_ = []
    for n in df.columns:
        if n in skip or n.startswith("_") or n.endswith("_qualifier"):
            continue
        kind = f', "value_type_id": "{VALUE_TYPES[n]}"' if n in VALUE_TYPES else ""
        name = n if n.startswith(f"{NS}:") else f"{NS}:{n}"
        v = _json_value(df, n, n in ("provided_by", "xref", "synonym"))
        empty = F.size(col(n)) == 0 if isinstance(df.schema[n].dataType, T.ArrayType) else F.lit(False)
        parts_.append(F.when(col(n).isNotNull() & ~empty, F.concat(F.lit(f'{{"attribute_type_id": "{name}", "value": '), v, F.lit(kind + "}"))))
    return F.concat(F.lit("["), F.concat_ws(", ", *parts_) if parts_ else F.lit(""), F.lit("]"))


def trapi(kg: KG, knowledge_source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``k, v`` of nodes and edges of a TRAPI knowledge graph; of several records of a
    key the last by ``seq`` counts."""
    n, e = _lasting(kg.nodes, ["id"]), _lasting(kg.edges, ["id"] if "id" in kg.edges.columns else ["subject", "predicate", "object"])
    many = "category" in n.columns and isinstance(n.schema["category"].dataType, T.ArrayType)
    cats = F.coalesce(F.col("category") if many else F.array("category"), F.array(F.lit(DEFAULT_CATEGORY))) if "category" in n.columns else F.array(F.lit(DEFAULT_CATEGORY))
    cats = F.transform(cats, lambda c: F.when(c.startswith(f"{NS}:"), c).otherwise(F.concat(F.lit(f"{NS}:"), c)))
    name = _json_value(n, "name", False) if "name" in n.columns else F.lit(None).cast("string")
    v = F.concat(F.lit('{"categories": '), F.to_json(cats), F.coalesce(F.concat(F.lit(', "name": '), name), F.lit("")), F.lit(', "attributes": '), _attributes(n, ("id", "name", "category", "is_set", *HIDDEN)), F.lit("}"))
    nodes = n.select(F.col("id").alias("k"), v.alias("v"))
    infores = lambda c: F.when(c.startswith("infores:"), c).otherwise(F.concat(F.lit("infores:"), c))
    primary = F.coalesce(F.col("primary_knowledge_source") if "primary_knowledge_source" in e.columns else F.lit(None).cast("string"), F.lit(knowledge_source or "infores:unknown"))
    pj = F.concat(F.lit('{"resource_id": "'), infores(primary), F.lit('", "resource_role": "primary_knowledge_source"'))
    if "pks_record_urls" in e.columns:
        pj = F.concat(pj, F.coalesce(F.concat(F.lit(', "source_record_urls": '), _json_value(e, "pks_record_urls", True)), F.lit("")))
    sources = [F.concat(pj, F.lit("}"))]
    if "provided_by" in e.columns:
        by = F.col("provided_by") if isinstance(e.schema["provided_by"].dataType, T.ArrayType) else F.array("provided_by")
        other = F.filter(by, lambda x: x.isNotNull() & (x != primary))
        sources.append(F.array_join(F.transform(other, lambda x: F.concat(F.lit('{"resource_id": "'), infores(x), F.lit('", "resource_role": "aggregator_knowledge_source"}'))), ", "))
    src = F.concat(F.lit("["), F.concat_ws(", ", *[F.when(s != "", s) for s in sources]), F.lit("]"))
    quals = [F.when(col(q).isNotNull(), F.concat(F.lit(f'{{"qualifier_type_id": "{NS}:{q}", "qualifier_value": '), _json_value(e, q, False), F.lit("}"))) for q in e.columns if q.endswith("_qualifier")]
    q = F.concat_ws(", ", *quals) if quals else F.lit("")
    text = lambda c: _json_value(e, c, False)
    skip = ("id", "subject", "predicate", "object", "primary_knowledge_source", "pks_record_urls", "provided_by", "qualifiers", *HIDDEN)
    v = F.concat(
        F.lit('{"predicate": '), text("predicate"), F.lit(', "subject": '), text("subject"), F.lit(', "object": '), text("object"), F.lit(', "attributes": '), _attributes(e, skip),
        F.lit(', "sources": '), src, F.when(q != "", F.concat(F.lit(', "qualifiers": ['), q, F.lit("]"))).otherwise(""), F.lit("}"),
    )
    return nodes, e.select((F.col("id") if "id" in e.columns else edge_key()).alias("k"), v.alias("v"))


def _lasting(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last whole record of every key, before its text is made, which is much longer."""
    if keys == ["id"] and "subject" in df.columns:
        df = df.withColumn("id", F.coalesce("id", edge_key()))
    rest = [c for c in df.columns if c not in keys and c != "seq"]
    if not rest:
        return df.select(*keys).distinct()
    last = F.max_by(F.struct(*[col(c) for c in rest]), F.col("seq") if "seq" in df.columns else F.lit(0))
    got = df.groupBy(*keys).agg(last.alias("_last"))
    return got.select(*[col(c) if c in keys else F.col("_last").getField(c).alias(c) for c in df.columns if c != "seq"])


def write_trapi(spark: SparkSession, kg: KG, path: str, knowledge_source: str | None = None, version: str = "4.2.5", compression: str | None = None) -> str:
    """A TRAPI knowledge graph; for a path ending in ``.jsonl`` a folder of typed lines,
    which may be compressed."""
    nodes, edges = trapi(kg, knowledge_source)
    if path.endswith(".jsonl"):
        typed = lambda df, t: df.select(F.concat(F.lit(f'{{"type": "{t}", "id": "'), F.regexp_replace("k", r'(["\\])', r"\\$1"), F.lit('", '), F.substring("v", 2, 1 << 30)).alias("value"))
        _writer(typed(nodes, "node").unionByName(typed(edges, "edge")), compression).text(path)
        return path
    return write_document(spark, {"nodes": nodes, "edges": edges}, path, f'{{"knowledge_graph": {{"{NS}_version": "{version}", ', "}}\n")


def shown_properties(kg: KG) -> tuple[list[str], list[str]]:
    """Used columns of nodes and edges, in the order in which they are written."""
    return ordered(used_properties(kg.nodes.drop(*HIDDEN)), NODE_ORDER), ordered(used_properties(kg.edges.drop(*HIDDEN)), EDGE_ORDER)

