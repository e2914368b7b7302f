"""Directed acyclic graphs and what only they allow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.semirings import MAX_PLUS, MIN_PLUS
from arcweave.model import Graph, node_frame
from arcweave.operators import kernels, transform
from arcweave.operators.connectivity import reachability_counts
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.paths import Path, distances_from
from arcweave.operators.traversal import levels, topological_generations as generations_of, topological_sort as sort_of
from arcweave.plans.materialize import materialize, stat


class CycleDetected(ValueError):
    """The edges hold a cycle."""


@dataclass(frozen=True)
class Dag:
    """A validated graph; ``generations`` (id, generation) comes from the check."""

    graph: Graph
    generations: DataFrame

    @staticmethod
    def from_graph(g: Graph) -> Dag:
        if not g.directed:
            raise CycleDetected("an undirected graph is not a DAG")
        generations, acyclic = generations_of(g)
        if not acyclic:
            raise CycleDetected("the graph has a cycle")
        return Dag(g, materialize(generations, "generations"))

    @staticmethod
    def empty() -> Dag:
        return Dag.from_graph(Graph.empty(True))

    @staticmethod
    def from_edges(edges) -> Dag:
        return Dag.from_graph(Graph.from_edges(edges, True))

    @staticmethod
    def from_unweighted_edges(edges) -> Dag:
        return Dag.from_graph(Graph.from_unweighted_edges(edges, True))

    @staticmethod
    def from_edges_with_default_weight(edges, default: object) -> Dag:
        return Dag.from_edges([(s, d, default) for s, d in edges])

    def to_graph(self) -> Graph:
        return self.graph

    def add_node(self, node: int, data: object) -> Dag:
        return Dag.from_graph(self.graph.add_node(node, data))

    def remove_node(self, node: int) -> Dag:
        return Dag.from_graph(self.graph.remove_node(node))

    def remove_edge(self, src: int, dst: int) -> Dag:
        return Dag.from_graph(self.graph.remove_edge(src, dst))

    def add_edge(self, src: int, dst: int, w: object, data: object = None) -> Dag:
        """Raises :class:`CycleDetected` if ``dst`` reaches ``src``; absent ends are made."""
        if src == dst or self.reachable(dst, src):
            raise CycleDetected(f"{src} -> {dst} closes a cycle")
        return Dag.from_graph(self.graph.add_edge_ensured(src, dst, w, data, data))

    def has_node(self, node: int) -> bool:
        return self.graph.has_node(node)

    def has_edge(self, src: int, dst: int) -> bool:
        return self.graph.has_edge(src, dst)

    def node_count(self) -> int:
        return self.graph.order()

    def edge_count(self) -> int:
        return self.graph.edge_count()

    def nodes(self) -> DataFrame:
        return self.graph.all_nodes()

    def successors(self, node: int) -> DataFrame:
        return self.graph.successors(node)

    def predecessors(self, node: int) -> DataFrame:
        return self.graph.predecessors(node)

    def in_degree(self, node: int) -> int:
        return self.graph.in_degree(node)

    def out_degree(self, node: int) -> int:
        return self.graph.out_degree(node)

    def reachable(self, src: int, dst: int) -> bool:
        return src == dst or not descendants(self, src).where(F.col("id") == dst).isEmpty()


def topological_generations(dag: Dag) -> DataFrame:
    """(id, generation)."""
    return dag.generations


def topological_sort(dag: Dag, max_edges: int = MAX_EDGES) -> list[int]:
    return sort_of(dag.graph, max_edges)


def sources(dag: Dag) -> DataFrame:
    return dag.graph.nodes.select("id").join(dag.graph.edges.select(F.col("dst").alias("id")), "id", "left_anti").orderBy("id")


def sinks(dag: Dag) -> DataFrame:
    return dag.graph.nodes.select("id").join(dag.graph.edges.select(F.col("src").alias("id")), "id", "left_anti").orderBy("id")


def descendants(dag: Dag, node: int) -> DataFrame:
    """(id) of what ``node`` reaches, with itself."""
    return levels(dag.graph.arcs(), node_frame([(node, None)])).select("id")


def ancestors(dag: Dag, node: int) -> DataFrame:
    """(id) of what reaches ``node``, with itself."""
    back = dag.graph.arcs().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return levels(back, node_frame([(node, None)])).select("id")


def transitive_closure(dag: Dag, combine: str = "min") -> Graph:
    return transform.transitive_closure(dag.graph, combine)


def transitive_reduction(dag: Dag) -> Graph:
    return transform.transitive_reduction(dag.graph)


def count_reachability(dag: Dag, direction: str = "descendants") -> DataFrame:
    return reachability_counts(dag.graph, direction)


def single_source_distances(dag: Dag, node: int) -> DataFrame:
    """(id, dist), negative weights allowed; nothing if the node is absent."""
    return distances_from(dag.graph, dag.graph.nodes.where(F.col("id") == node).select("id"), MIN_PLUS).select(F.col("dst").alias("id"), "dist")


def longest_distances(dag: Dag) -> DataFrame:
    """(id, dist): the largest weight of a path that ends at each node, starting anywhere at 0.

    One round per generation, by generations: a node is final when its turn comes.
    """
    g = dag.graph
    at = materialize(dag.generations, "generations")
    deepest = at.agg(F.max("generation").alias("m")).first()["m"]
    arcs = materialize(g.arcs().join(at.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "w", "generation"), "arcs")
    zero = F.lit(0).cast(g.edges.schema["w"].dataType)
    done = at.where("generation = 0").select("id", zero.alias("dist"))
    for i in range(1, (deepest or 0) + 1):
        front = arcs.where(F.col("generation") == i).join(done, F.col("src") == done["id"]).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("dist") + F.col("w")).alias("dist"))
        done = materialize(done.unionByName(front.select("id", F.greatest("dist", zero).alias("dist"))), "longest")
    return done


def longest_path(dag: Dag, max_edges: int = MAX_EDGES) -> list[int]:
    """The nodes of a heaviest path; [] without edges."""
    local = Local.of(dag.graph, max_edges)
    order = kernels.topological_order(local)
    best, parent = dict.fromkeys(order, 0), dict.fromkeys(order)
    for u in order:
        for v, w in local.out[u].items():
            if best[u] + w > best[v] or (parent[v] is None and best[u] + w >= best[v]):
                best[v], parent[v] = best[u] + w, u
    if not local.size():
        return []
    end = max((n for n in order if parent[n] is not None), key=lambda n: (best[n], -n))
    return kernels.trace(parent, end)


def _between(dag: Dag, src: int, dst: int, better, max_edges: int) -> Path | None:
    local = Local.of(dag.graph, max_edges)
    if src not in local.out or dst not in local.out:
        return None
    dist, parent = {src: 0}, {src: None}
    for u in kernels.topological_order(local):
        if u in dist:
            for v, w in local.out[u].items():
                if v not in dist or better(dist[u] + w, dist[v]):
                    dist[v], parent[v] = dist[u] + w, u
    return Path(kernels.trace(parent, dst), dist[dst]) if dst in dist else None


def shortest_path(dag: Dag, src: int, dst: int, max_edges: int = MAX_EDGES) -> Path | None:
    return _between(dag, src, dst, lambda a, b: a < b, max_edges)


def longest_path_between(dag: Dag, src: int, dst: int, max_edges: int = MAX_EDGES) -> Path | None:
    return _between(dag, src, dst, lambda a, b: a > b, max_edges)


def longest_distances_from(dag: Dag, node: int) -> DataFrame:
    """(id, dist): the largest weight of a path from ``node``, relationally."""
    return distances_from(dag.graph, node_frame([(node, None)]).select("id"), MAX_PLUS).select(F.col("dst").alias("id"), "dist")


def path_counts(dag: Dag, src: int) -> DataFrame:
    """(id, n): how many paths lead from ``src`` to each node, one round per hop of the longest."""
    arcs = materialize(dag.graph.arcs().select("src", "dst"), "arcs")
    front = materialize(dag.graph.nodes.where(F.col("id") == src).select("id", F.lit(1).cast("decimal(38,0)").alias("n")), "counts")
    total, more = front, True
    while more:
        front = materialize(front.join(arcs, front["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum("n").cast("decimal(38,0)").alias("n")), "counts", rows=F.count(F.lit(1)))
        more = stat(front, "rows")
        total = materialize(total.unionByName(front).groupBy("id").agg(F.sum("n").cast("decimal(38,0)").alias("n")), "counts")
    return total


def path_count(dag: Dag, src: int, dst: int) -> int:
    row = path_counts(dag, src).where(F.col("id") == dst).first()
    return int(row["n"]) if row else 0


def lowest_common_ancestors(dag: Dag, a: int, b: int) -> DataFrame:
    """(id) of common ancestors (the nodes count as their own) from which no other one is reached."""
    common = materialize(ancestors(dag, a).join(ancestors(dag, b), "id", "left_semi"), "common")
    inner = transform.induced(dag.graph, common).arcs()
    return common.join(inner.select(F.col("src").alias("id")), "id", "left_anti")
