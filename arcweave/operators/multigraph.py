"""Graphs with parallel edges, keyed by edge id."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Combine, Graph, canonical, combined, node_frame
from arcweave.operators.euler_rounds import listed, tours_exist
from arcweave.operators.local import MAX_EDGES
from arcweave.operators.transform import TooLarge


@dataclass(frozen=True)
class MultiGraph:
    """``edges`` has (eid, src, dst, w); ends need not be nodes."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def empty(directed: bool = True) -> MultiGraph:
        return MultiGraph.from_edges([], directed)

    @staticmethod
    def new_directed() -> MultiGraph:
        return MultiGraph.empty(True)

    @staticmethod
    def new_undirected() -> MultiGraph:
        return MultiGraph.empty(False)

    @staticmethod
    def from_edges(edges, directed: bool = True) -> MultiGraph:
        """From (src, dst, w); edge ids by position, ends become nodes."""
        edges = list(edges)
        frame = _frame([(i, s, d, w) for i, (s, d, w) in enumerate(edges)])
        return MultiGraph(node_frame([(n, None) for n in sorted({x for s, d, _ in edges for x in (s, d)})]), frame, directed)

    def add_node(self, node: int, data: object) -> MultiGraph:
        held = Graph(self.nodes, Graph.empty().edges).add_node(node, data)
        return MultiGraph(held.nodes, self.edges, self.directed)

    def next_edge_id(self) -> int:
        top = self.edges.agg(F.max("eid").alias("m")).first()["m"]
        return 0 if top is None else top + 1

    def add_edge(self, src: int, dst: int, w: object) -> tuple[MultiGraph, int]:
        eid = self.next_edge_id()
        return MultiGraph(self.nodes, self.edges.unionByName(_frame([(eid, src, dst, w)])), self.directed), eid

    def remove_edge(self, eid: int) -> MultiGraph:
        return MultiGraph(self.nodes, self.edges.where(F.col("eid") != eid), self.directed)

    def remove_node(self, node: int) -> MultiGraph:
        return MultiGraph(self.nodes.where(F.col("id") != node), self.edges.where((F.col("src") != node) & (F.col("dst") != node)), self.directed)

    def all_nodes(self) -> DataFrame:
        return self.nodes.select("id").orderBy("id")

    def order(self) -> int:
        return self.nodes.count()

    def size(self) -> int:
        return self.edges.count()

    def has_edge(self, eid: int) -> bool:
        return not self.edges.where(F.col("eid") == eid).isEmpty()

    def all_edge_ids(self) -> DataFrame:
        return self.edges.select("eid").orderBy("eid")

    def arcs(self) -> DataFrame:
        if self.directed:
            return self.edges
        return self.edges.unionByName(self.edges.where("src <> dst").select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))

    def edges_between(self, a: int, b: int) -> DataFrame:
        return self.arcs().where((F.col("src") == a) & (F.col("dst") == b)).select("eid", "w").orderBy("eid")

    def edge_count(self, a: int, b: int) -> int:
        return self.edges_between(a, b).count()

    def successors(self, node: int) -> DataFrame:
        return self.arcs().where(F.col("src") == node).select(F.col("dst").alias("id"), "eid", "w").orderBy("eid")

    def predecessors(self, node: int) -> DataFrame:
        return self.arcs().where(F.col("dst") == node).select(F.col("src").alias("id"), "eid", "w").orderBy("eid")

    def _loops(self, node: int) -> int:
        return 0 if self.directed else self.edges.where((F.col("src") == node) & (F.col("dst") == node)).count()

    def out_degree(self, node: int) -> int:
        """Edges out; an undirected loop counts twice."""
        return self.successors(node).count() + self._loops(node)

    def in_degree(self, node: int) -> int:
        return self.predecessors(node).count() + self._loops(node)

    def degree(self, node: int) -> int:
        return self.out_degree(node) + (self.in_degree(node) if self.directed else 0)

    def to_simple_graph(self, combine: str | Combine | None = None) -> Graph:
        """One edge for each pair: ``combine`` in order of edge id, by default the first."""
        edges = canonical(self.edges, self.directed)
        value = F.min_by("w", "eid") if combine is None else combined("w", combine, F.col("eid"))
        return Graph(self.nodes, edges.groupBy("src", "dst").agg(value.alias("w")), self.directed)

    def to_simple_graph_min_edges(self) -> Graph:
        return self.to_simple_graph("min")

    def to_simple_graph_max_edges(self) -> Graph:
        return self.to_simple_graph("max")

    def to_simple_graph_sum_edges(self) -> Graph:
        return self.to_simple_graph("sum")

    def local_arcs(self, max_edges: int = MAX_EDGES) -> dict[int, list[tuple[int, int]]]:
        rows = self.edges.limit(max_edges + 1).collect()
        if len(rows) > max_edges:
            raise TooLarge(f"a sequential algorithm got more than {max_edges} edges")
        arcs: dict = {}
        for r in sorted(rows, key=lambda r: r["eid"]):
            arcs.setdefault(r["src"], []).append((r["dst"], r["eid"]))
            arcs.setdefault(r["dst"], [])
            if not self.directed and r["src"] != r["dst"]:
                arcs[r["dst"]].append((r["src"], r["eid"]))
        return arcs


def _frame(rows) -> DataFrame:
    from arcweave.model import edge_frame

    made = edge_frame([(s, d, w) for _, s, d, w in rows])
    ids = node_frame([(i, None) for i, *_ in rows])
    if not rows:
        return made.select(F.lit(0).cast("long").alias("eid"), "src", "dst", "w")
    from pyspark.sql import types as T

    kind = made.schema["w"].dataType
    fields = [T.StructField(n, T.LongType()) for n in ("eid", "src", "dst")] + [T.StructField("w", kind)]
    cast = float if isinstance(kind, T.DoubleType) else (lambda x: x)
    return ids.sparkSession.createDataFrame([(i, s, d, None if w is None else cast(w)) for i, s, d, w in rows], T.StructType(fields))


def fold_walk(mg: MultiGraph, start: int, initial, folder):
    """Breadth-first fold, each node once; ``folder(acc, node, depth, (parent, eid))`` gives (control, acc)."""
    arcs, acc = mg.local_arcs(), initial
    todo, seen = deque([(start, 0, None)]), {start}
    while todo:
        node, depth, parent = todo.popleft()
        control, acc = folder(acc, node, depth, parent)
        if control == "halt":
            break
        if control == "stop":
            continue
        for v, e in arcs.get(node, ()):
            if v not in seen:
                seen.add(v)
                todo.append((v, depth + 1, (node, e)))
    return acc


def bfs(mg: MultiGraph, start: int) -> list[int]:
    return fold_walk(mg, start, [], lambda acc, n, *_: (acc.append(n) or "continue", acc))


def dfs(mg: MultiGraph, start: int) -> list[int]:
    arcs, out, seen, stack = mg.local_arcs(), [], set(), [start]
    while stack:
        n = stack.pop()
        if n not in seen:
            seen.add(n)
            out.append(n)
            stack.extend(v for v, _ in reversed(arcs.get(n, ())) if v not in seen)
    return out


def has_eulerian_circuit(mg: MultiGraph) -> bool:
    return tours_exist(mg.edges, mg.directed)[0]


def has_eulerian_path(mg: MultiGraph) -> bool:
    return tours_exist(mg.edges, mg.directed)[1]


def _walk(mg: MultiGraph, closed: bool, max_edges: int) -> list[int] | None:
    rows = listed(mg.edges.select(F.col("eid").alias("edge"), "src", "dst"), mg.directed, closed, max_edges)
    return None if rows is None else [r["edge"] for r in rows]


def find_eulerian_circuit(mg: MultiGraph, max_edges: int = MAX_EDGES) -> list[int] | None:
    """Edge ids in walking order."""
    return _walk(mg, True, max_edges)


def find_eulerian_path(mg: MultiGraph, max_edges: int = MAX_EDGES) -> list[int] | None:
    return _walk(mg, False, max_edges)
