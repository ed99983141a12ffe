"""What the property-graph model declares: properties, classes, predicates, prefixes.

Class names, hierarchy, slots and identifier prefixes are those of a public model (CC0),
packaged as data files: nothing is fetched.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache
from importlib.resources import files
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DATA = files("sparkloom") / "data"
_MODEL = json.loads((_DATA / "model.json").read_text())

#: Prefix of the model's own classes and slots.
NS = _MODEL["namespace"]
NODE_CORE = tuple(_MODEL["node_core"])
EDGE_CORE = tuple(_MODEL["edge_core"])
DEFAULT_CATEGORY = _MODEL["default_category"]
DEFAULT_PREDICATE = _MODEL["default_predicate"]
#: Types at import: ``list``, ``bool`` or ``str``.
IMPORT_TYPES = _MODEL["import_types"]
PROVENANCE = tuple(_MODEL["provenance"])
#: Cardinality at merge: True for properties with several values.
MULTIVALUED = _MODEL["multivalued"]
#: Other slots of the model that hold several values.
LIST_SLOTS = frozenset(_MODEL["list_slots"])
REQUIRED_NODE = tuple(_MODEL["required_node"])
REQUIRED_EDGE = tuple(_MODEL["required_edge"])
PREDICATES = tuple(_MODEL["predicates"])
EXTRA_PREFIXES = _MODEL["extra_prefixes"]


@dataclass(frozen=True)
class Catalog:
    """The declared model. ``classes``: name to ``{p: parent, m: mixins, x: is a mixin,
    i: rank by identifier prefix, a: aliases}``."""

    classes: dict = field(hash=False)
    prefixes: dict[str, str] = field(hash=False)
    predicates: tuple[str, ...] = PREDICATES
    version: str = ""

    def ancestors(self, name: str) -> list[str]:
        """The class and all above it, mixins of each included, nearest first."""
        out, queue = [], [name]
        while queue:
            c = queue.pop(0)
            if c in self.classes and c not in out:
                out.append(c)
                d = self.classes[c]
                queue += ([d["p"]] if "p" in d else []) + d.get("m", [])
        return out

    def is_mixin(self, name: str) -> bool:
        return bool(self.classes.get(name, {}).get("x"))

    def id_prefixes(self, name: str) -> list[str]:
        """The identifier prefixes of a class, most preferred first."""
        i = self.classes.get(name, {}).get("i", {})
        return sorted(i, key=lambda p: (i[p], p))

    def aliases(self) -> dict[str, str]:
        """Alias to class name."""
        return {a: c for c, d in self.classes.items() for a in d.get("a", [])}

    def ancestor_table(self, spark: SparkSession) -> DataFrame:
        """``category, ancestor, distance, mixin``: a fixed-size table, safe to broadcast."""
        rows = [(f"{NS}:{c}", f"{NS}:{a}", n, self.is_mixin(a)) for c in self.classes for n, a in enumerate(self.ancestors(c))]
        return spark.createDataFrame(rows, "category string, ancestor string, distance int, mixin boolean")

    def prefix_table(self, spark: SparkSession) -> DataFrame:
        """``category, prefix, rank``."""
        rows = [(f"{NS}:{c}", p, n) for c in self.classes for n, p in enumerate(self.id_prefixes(c))]
        return spark.createDataFrame(rows, "category string, prefix string, rank int")

    def is_list(self, name: str) -> bool:
        """Whether a property holds several values when merged or validated."""
        return MULTIVALUED.get(name, name in LIST_SLOTS)


@lru_cache(8)
def catalog(folder: str | None = None) -> Catalog:
    """The packaged model, or that of another version whose ``classes.json``,
    ``prefixes.json`` and ``model.json`` lie in a folder."""
    data = _DATA if folder is None else Path(folder)
    model = _MODEL if folder is None else json.loads((data / "model.json").read_text())
    read = lambda n: json.loads((data / n).read_text())
    return Catalog(read("classes.json"), {**read("prefixes.json"), **model["extra_prefixes"]}, tuple(model["predicates"]), model.get("version", ""))
