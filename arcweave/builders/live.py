"""A log of changes to a labelled graph, replayed in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.builders.labeled import Labeled
from arcweave.model import Graph, canonical, last_wins


@dataclass(frozen=True)
class Live:
    """Registered labels, the next id, and pending changes (op, a, b, payload)."""

    registry: dict = field(default_factory=dict)
    next_id: int = 0
    pending: tuple = ()

    @staticmethod
    def create() -> Live:
        return Live({}, 0, ())

    new_directed = new_undirected = create

    @staticmethod
    def from_labeled(b: Labeled) -> Live:
        return Live(dict(b.registry), b.next_id(), ())

    def _ensure(self, label) -> tuple[Live, int]:
        if label in self.registry:
            return self, self.registry[label]
        i = self.next_id
        return Live({**self.registry, label: i}, i + 1, (*self.pending, ("add_node", i, None, label))), i

    def add_edge(self, a, b, w) -> Live:
        x, s = self._ensure(a)
        x, d = x._ensure(b)
        return Live(x.registry, x.next_id, (*x.pending, ("add_edge", s, d, w)))

    def add_simple_edge(self, a, b) -> Live:
        return self.add_edge(a, b, 1)

    def add_unweighted_edge(self, a, b) -> Live:
        return self.add_edge(a, b, None)

    def remove_edge(self, a, b) -> Live:
        if a not in self.registry or b not in self.registry:
            return self
        return Live(self.registry, self.next_id, (*self.pending, ("remove_edge", self.registry[a], self.registry[b], None)))

    def remove_node(self, label) -> Live:
        """The label is free again and gets a new id when it returns."""
        if label not in self.registry:
            return self
        rest = {k: v for k, v in self.registry.items() if k != label}
        return Live(rest, self.next_id, (*self.pending, ("remove_node", self.registry[label], None, None)))

    def get_id(self, label) -> int | None:
        return self.registry.get(label)

    def all_labels(self) -> list:
        return sorted(self.registry)

    def node_count(self) -> int:
        return len(self.registry)

    def pending_count(self) -> int:
        return len(self.pending)

    def purge_pending(self) -> Live:
        return Live(self.registry, self.next_id, ())

    checkpoint = purge_pending

    def sync(self, g: Graph) -> tuple[Live, Graph]:
        """Replay the pending changes onto ``g``: (log without them, graph)."""
        nodes: dict = {}
        edges: dict = {}
        gone: set[int] = set()
        key = (lambda s, d: (s, d)) if g.directed else (lambda s, d: (min(s, d), max(s, d)))
        for op, a, b, x in self.pending:
            if op == "add_node":
                nodes[a] = x
            elif op == "add_edge":
                edges[key(a, b)] = x
            elif op == "remove_edge":
                edges[key(a, b)] = _GONE
            else:
                nodes.pop(a, None)
                gone.add(a)
                edges = {e: w for e, w in edges.items() if a not in e}
        if gone:
            out = [int(n) for n in gone]
            g = Graph(g.nodes.where(~F.col("id").isin(out)), g.edges.where(~F.col("src").isin(out) & ~F.col("dst").isin(out)), g.directed)
        if nodes:
            g = g.add_nodes_from(list(nodes.items()))
        for s, d in [e for e, w in edges.items() if w is _GONE]:
            g = g.remove_edge(s, d)
        return self.purge_pending(), g.add_edges_ensured([(s, d, w) for (s, d), w in edges.items() if w is not _GONE])


_GONE = object()


def apply_log(g: Graph, log: DataFrame) -> Graph:
    """Apply a change log (seq, op, src, dst, label, w) of any size to ``g``, relationally.

    For each node and each edge only its last change counts; an edge also goes
    with the last removal of either end that follows it.
    """
    nodes = last_wins(log.where("op IN ('add_node', 'remove_node')").select(F.col("src").alias("id"), "op", "label", "seq"), ["id"], "seq")
    removed = log.where("op = 'remove_node'").groupBy(F.col("src").alias("id")).agg(F.max("seq").alias("gone"))
    kept = g.nodes.join(nodes.select("id"), "id", "left_anti").unionByName(nodes.where("op = 'add_node'").select("id", F.col("label").cast(g.nodes.schema["data"].dataType).alias("data")))
    new = canonical(log.where("op IN ('add_edge', 'remove_edge')").select("src", "dst", "op", "w", "seq"), g.directed)
    new = new.withColumn("at", F.col("seq"))
    last = last_wins(new, ["src", "dst"], "seq")
    old = g.edges.select("src", "dst", F.lit("add_edge").alias("op"), "w", F.lit(-1).cast("long").alias("at")).join(last.select("src", "dst"), ["src", "dst"], "left_anti")
    both = old.unionByName(last.select("src", "dst", "op", F.col("w").cast(g.edges.schema["w"].dataType).alias("w"), F.col("at").cast("long").alias("at"))).where("op = 'add_edge'")
    s, d = removed.select(F.col("id").alias("src"), F.col("gone").alias("gs")), removed.select(F.col("id").alias("dst"), F.col("gone").alias("gd"))
    alive = both.join(s, "src", "left").join(d, "dst", "left").where("(gs IS NULL OR gs < at) AND (gd IS NULL OR gd < at)")
    return Graph(kept, alive.select("src", "dst", "w"), g.directed)
