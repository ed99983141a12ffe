"""A property graph: a pair of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class KG:
    """``nodes`` have ``id``; ``edges`` have ``subject``, ``predicate`` and ``object``.

    Other columns are properties; an absent property is null. Graphs are immutable: an
    operator returns a new one, and nothing is computed before an action. ``made`` names
    the edges' columns (``edge_key, id``) that follow from their ends and predicate, so that
    they need not be moved; it holds for these edges only.
    """

    nodes: DataFrame
    edges: DataFrame
    name: str = "graph"
    made: tuple[str, ...] = ()

    def with_(self, **changes) -> KG:
        if "edges" in changes:
            changes.setdefault("made", ())
        return replace(self, **changes)

    def checkpoint(self) -> KG:
        """Cut the lineage, in the cluster's shared checkpoint folder."""
        from .operators.components import ensure_checkpoint_dir

        ensure_checkpoint_dir(self.nodes.sparkSession)
        return self.with_(nodes=self.nodes.checkpoint(), edges=self.edges.checkpoint())
