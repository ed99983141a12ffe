"""CURIE, IRI and name-case functions as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import NS

CURIE = r"^[^ <()>:]*:[^/ :]+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_curie(c: Column | str) -> Column:
    """True for ``prefix:reference``; false for anything else, null included."""
    return F.coalesce(_c(c).rlike(CURIE), F.lit(False))


def is_iri(c: Column | str) -> Column:
    """True if the string starts with ``http``."""
    return F.coalesce(_c(c).startswith("http"), F.lit(False))


def has_fragment(c: Column | str) -> Column:
    """True if the string has a ``#``."""
    return F.coalesce(_c(c).contains("#"), F.lit(False))


def prefix_of(c: Column | str) -> Column:
    """The part before the colon (empty for ``:1``), null if this is no CURIE."""
    return F.when(is_curie(c), F.substring_index(_c(c), ":", 1))


def reference_of(c: Column | str) -> Column:
    """The part after the colon, null if this is no CURIE."""
    return F.when(is_curie(c), F.substring_index(_c(c), ":", -1))


def _map(m: dict[str, str]) -> Column:
    """A map of constants, which Catalyst folds; one call however many there are."""
    return F.from_json(F.lit(json.dumps(m)), "map<string,string>")


def _looked_up(m: dict[str, str], key: Column) -> Column:
    """The value of a key in constants. A map is searched from its start, so that they are
    divided by a checksum into as many maps, of which one is searched."""
    if len(m) < 8:
        return F.element_at(_map(m), key)
    n = len(m)
    parts: list[dict[str, str]] = [{} for _ in range(n)]
    for k, v in m.items():
        parts[crc32(k.encode()) % n][k] = v
    table = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    return F.element_at(F.element_at(table, (F.crc32(key.cast("binary")) % n + 1).cast("int")), key)


def constants(values: Iterable[str]) -> Column:
    """An array of constants, which Catalyst folds."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def expand(c: Column | str, prefixes: dict[str, str]) -> Column:
    """The IRI of a CURIE; the input where its prefix is not mapped."""
    if not prefixes:
        return _c(c)
    return F.coalesce(F.concat(_looked_up(prefixes, prefix_of(c)), reference_of(c)), _c(c))


def _trie(strings: list[str]) -> str:
    """A regular expression for the longest of the strings that a text starts with, which
    reads each character once however many strings there are."""
    ends, by = "" in strings, {}
    for x in strings:
        if x:
            by.setdefault(x[0], []).append(x[1:])
    if not by:
        return ""
    rest = "|".join((c if c.isalnum() else "\\" + c) + _trie(tails) for c, tails in sorted(by.items()))
    return f"(?:{rest})" + ("?" if ends else "") if ends or len(by) > 1 else rest


def contract(c: Column | str, prefixes: dict[str, str], exact: dict[str, str] | None = None) -> Column:
    """The CURIE of an IRI: an exact mapping first, then the longest IRI prefix (of equal
    ones the first by name), else the input."""
    by_iri = {iri: p for p, iri in sorted(prefixes.items(), reverse=True) if iri}
    out = _c(c)
    if by_iri:
        head = F.regexp_extract(_c(c), "^" + _trie(list(by_iri)), 0)
        out = F.coalesce(F.concat(_looked_up(by_iri, head), F.lit(":"), F.substring(_c(c), F.length(head) + 1, F.length(_c(c)))), _c(c))
    return F.coalesce(_looked_up(exact, _c(c)), out) if exact else out


def camel_to_sentence(c: Column | str) -> Column:
    """``NamedThing`` to ``named thing``."""
    return F.lower(F.trim(F.regexp_replace(_c(c), r"([A-Z])", " $1")))


def snake_to_sentence(c: Column | str) -> Column:
    """``named_thing`` to ``named thing``."""
    return F.lower(F.trim(F.regexp_replace(_c(c), r"[\-_.\s]", " ")))


def sentence_to_snake(c: Column | str) -> Column:
    """``named thing`` to ``named_thing``."""
    return F.lower(F.regexp_replace(F.trim(_c(c)), r"[\-.\s]", "_"))


def sentence_to_camel(c: Column | str) -> Column:
    """``named thing`` to ``NamedThing``; letters inside a word keep their case."""
    words = F.split(sentence_to_snake(c), "_")
    return F.concat_ws("", F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))))


def category_curie(c: Column | str) -> Column:
    """A class name as a CURIE in CamelCase; CURIEs of that prefix as they are."""
    return F.when(_c(c).rlike(f"^{NS}:.+"), _c(c)).otherwise(F.concat(F.lit(f"{NS}:"), sentence_to_camel(c)))


def slot_curie(c: Column | str) -> Column:
    """A slot name as a CURIE in snake_case; CURIEs of that prefix as they are."""
    return F.when(_c(c).rlike(f"^{NS}:.+"), _c(c)).otherwise(F.concat(F.lit(f"{NS}:"), sentence_to_snake(c)))


def new_uuid() -> Column:
    """A random URN."""
    return F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))


def stable_id(*cols: Column | str) -> Column:
    """A URN that depends only on the given columns, for rewritable pipelines."""
    h = F.sha2(F.concat_ws("\u0001", *[F.coalesce(_c(c).cast("string"), F.lit("\u0000")) for c in cols]), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def millis_now() -> Column:
    """The current time in milliseconds."""
    return F.unix_millis(F.current_timestamp())


def arango_curie(c: Column | str) -> Column:
    """``collection/key`` or ``collection:key`` as ``collection:key``."""
    return F.regexp_replace(_c(c), r"^([^/:]+)/", "$1:")


def safe_key(c: Column | str) -> Column:
    """A document key without slashes."""
    return F.replace(_c(c), F.lit("/"), F.lit("_"))


def any_of(conditions: list[Column]) -> Column:
    """OR of the conditions; false if there are none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    """AND of the conditions; true if there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
