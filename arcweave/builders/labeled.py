"""Graphs whose nodes are named by labels."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, canonical, dense_ids, edge_frame, last_wins, node_frame


@dataclass(frozen=True)
class Labeled:
    """A registry of labels and the edges between their ids; every change makes a new builder."""

    directed: bool = True
    registry: dict = field(default_factory=dict)
    edges: dict = field(default_factory=dict)

    @staticmethod
    def create(directed: bool) -> Labeled:
        return Labeled(directed)

    @staticmethod
    def new_directed() -> Labeled:
        return Labeled(True)

    @staticmethod
    def new_undirected() -> Labeled:
        return Labeled(False)

    @staticmethod
    def from_list(rows, directed: bool = True) -> Labeled:
        """From (label, label, w)."""
        b = Labeled(directed, {}, {})
        for a, c, w in rows:
            b = b.add_edge(a, c, w)
        return b

    @staticmethod
    def from_unweighted_list(rows, directed: bool = True) -> Labeled:
        return Labeled.from_list([(a, b, None) for a, b in rows], directed)

    def next_id(self) -> int:
        return len(self.registry)

    def ensure_node(self, label) -> tuple[Labeled, int]:
        if label in self.registry:
            return self, self.registry[label]
        i = len(self.registry)
        return Labeled(self.directed, {**self.registry, label: i}, self.edges), i

    def add_node(self, label) -> Labeled:
        return self.ensure_node(label)[0]

    def add_edge(self, a, b, w) -> Labeled:
        x, s = self.ensure_node(a)
        x, d = x.ensure_node(b)
        key = (s, d) if self.directed else (min(s, d), max(s, d))
        return Labeled(self.directed, x.registry, {**x.edges, key: w})

    def add_simple_edge(self, a, b) -> Labeled:
        return self.add_edge(a, b, 1)

    def add_unweighted_edge(self, a, b) -> Labeled:
        return self.add_edge(a, b, None)

    def get_id(self, label) -> int | None:
        return self.registry.get(label)

    def to_registry(self) -> dict:
        return dict(self.registry)

    def all_labels(self) -> list:
        return sorted(self.registry)

    def _around(self, label, end: int) -> list[tuple] | None:
        if label not in self.registry:
            return None
        me, names = self.registry[label], {i: x for x, i in self.registry.items()}
        out = [(names[e[1 - end]], w) for e, w in sorted(self.edges.items()) if e[end] == me]
        if not self.directed:
            out += [(names[e[end]], w) for e, w in sorted(self.edges.items()) if e[1 - end] == me and e[0] != e[1]]
        return out

    def successors(self, label) -> list[tuple] | None:
        return self._around(label, 0)

    def predecessors(self, label) -> list[tuple] | None:
        return self._around(label, 1)

    def to_graph(self) -> Graph:
        return Graph(node_frame([(i, x) for x, i in self.registry.items()]), edge_frame([(s, d, w) for (s, d), w in self.edges.items()]), self.directed)


def from_labeled_frame(rows: DataFrame, directed: bool = True) -> Graph:
    """From a DataFrame (from_label, to_label, w) of any size: ids by order of label, the last repeat wins."""
    labels = rows.select(F.explode(F.array("from_label", "to_label")).alias("data")).distinct().where("data IS NOT NULL")
    ids = dense_ids(labels, "data", "id").select("id", "data")
    s, d = ids.select(F.col("id").alias("src"), F.col("data").alias("from_label")), ids.select(F.col("id").alias("dst"), F.col("data").alias("to_label"))
    edges = rows.withColumn("_at", F.monotonically_increasing_id()).join(s, "from_label").join(d, "to_label").select("src", "dst", "w", "_at")
    return Graph(ids, last_wins(canonical(edges, directed), ["src", "dst"], "_at"), directed)
