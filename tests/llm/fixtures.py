"""Small tables for the operators' tests."""

from __future__ import annotations

import random

WORDS = "the of river stone light garden window paper music letter summer winter forest mountain village bridge market teacher student kitchen bottle engine signal camera".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, u string, l1 string, `x.y` int, c0 string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def rows(texts: list, lang: str = "en", source: str = "s") -> list[tuple]:
    """Documents with extra columns whose names operators also use inside."""
    return [(i, t, lang, source, len(t) if t is not None else None, "kept", "u", "l", i, "c") for i, t in enumerate(texts)]


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and long texts, repeated rows and ids."""
    r = random.Random(4)
    long = " ".join(prose(r, 12) for _ in range(9000))
    out = rows(["", " \n ", None, prose(r, 40), prose(r, 40), long, "word"])
    out += [out[3], out[3], (3, "another text of the same id", "en", "t", 27, None, None, None, None, None)]
    out.append((None, prose(r, 30), None, None, None, None, None, None, None, None))
    out.append((90, prose(r, 30), None, None, None, None, None, None, None, None))
    return out


def frame(spark, data: list[tuple]):
    return spark.createDataFrame(data, SCHEMA)
