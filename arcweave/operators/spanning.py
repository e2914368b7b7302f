"""Spanning trees and arborescences."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators import kernels
from arcweave.operators.contraction import component_links
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.transform import TooLarge
from arcweave.plans.materialize import discard, materialize


@dataclass(frozen=True)
class MstResult:
    edges: list[tuple]
    total_weight: object
    algorithm: str
    root: int | None = None

    @property
    def edge_count(self) -> int:
        return len(self.edges)


@dataclass(frozen=True)
class ForestResult:
    """A forest as the DataFrame ``frame`` (src, dst, w); count and weight are aggregates of all its rows."""

    frame: DataFrame
    algorithm: str
    max_edges: int = MAX_EDGES
    root: int | None = None

    @cached_property
    def _sums(self):
        return self.frame.agg(F.count("*").alias("n"), F.sum("w").alias("w")).first()

    @property
    def edge_count(self) -> int:
        return self._sums["n"]

    @property
    def total_weight(self):
        return self._sums["w"] if self.edge_count else 0

    @cached_property
    def edges(self) -> list[tuple]:
        """The edges on the driver, ascending; raises :class:`TooLarge` where they are more than ``max_edges``."""
        rows = self.frame.limit(self.max_edges + 1).collect()
        if len(rows) > self.max_edges:
            raise TooLarge(f"a forest of more than {self.max_edges} edges is not listed on the driver")
        return sorted((r["src"], r["dst"], r["w"]) for r in rows)


class NoTree(ValueError):
    """There is no spanning tree of the kind asked for."""


def _undirected(g: Graph) -> None:
    if g.directed:
        raise NoTree("a spanning tree needs an undirected graph")


def _result(edges, algorithm: str, root: int | None = None) -> MstResult:
    return MstResult(edges, sum(w for *_, w in edges), algorithm, root)


def spanning_forest(g: Graph, max_rounds: int = 64) -> DataFrame:
    """(src, dst, w) of a minimum spanning forest, distributed.

    Each round every component takes its least edge by (w, src, dst) - a total
    order, so the picks never close a cycle - and components that meet merge.
    Rounds are logarithmic in the node count.
    """
    _undirected(g)
    edges = materialize(g.edges.where("src <> dst").select("src", "dst", "w", F.col("src").alias("cs"), F.col("dst").alias("cd")), "edges")
    tree = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        ends = edges.select(F.explode(F.array("cs", "cd")).alias("c"), F.struct("w", "src", "dst", "cs", "cd").alias("e"))
        picked = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "picked")
        tree = picked.select("src", "dst", "w") if tree is None else tree.unionByName(picked.select("src", "dst", "w"))
        to = materialize(component_links(picked, "cs", "cd"), "merged")
        s, d = to.select(F.col("node").alias("cs"), F.col("component").alias("ns")), to.select(F.col("node").alias("cd"), F.col("component").alias("nd"))
        moved = edges.join(s, "cs", "left").join(d, "cd", "left").select("src", "dst", "w", F.coalesce("ns", "cs").alias("cs"), F.coalesce("nd", "cd").alias("cd"))
        old, edges = edges, materialize(moved.where("cs <> cd"), "edges")
        discard(old, to)
    return tree if tree is not None else g.edges.where("false").select("src", "dst", "w")


def boruvka(g: Graph, max_edges: int = MAX_EDGES) -> ForestResult:
    """The distributed forest; only ``edges``, its list, is bound by ``max_edges``."""
    return ForestResult(spanning_forest(g), "boruvka", max_edges)


def kruskal(g: Graph, max_edges: int = MAX_EDGES) -> ForestResult:
    """A minimum spanning forest: the one of :func:`spanning_forest`, whose order of edges is total."""
    _undirected(g)
    return ForestResult(spanning_forest(g), "kruskal", max_edges)


def kruskal_by_component(g: Graph) -> DataFrame:
    """(src, dst, w) of the forest."""
    _undirected(g)
    return spanning_forest(g).select("src", "dst", F.col("w").cast("double").alias("w"))


def prim(g: Graph, max_edges: int = MAX_EDGES) -> ForestResult:
    """The tree of the smallest node's component."""
    _undirected(g)
    forest = materialize(spanning_forest(g), "forest")
    parts = materialize(component_links(forest, "src", "dst"), "parts")
    start = g.nodes.agg(F.min("id").alias("node"))
    tree = parts.join(parts.join(start, "node").select("component"), "component").select(F.col("node").alias("src"))
    return ForestResult(forest.join(tree, "src", "left_semi").select("src", "dst", "w"), "prim", max_edges)


def edmonds(g: Graph, root: int, max_edges: int = MAX_EDGES) -> MstResult:
    """The least arborescence from ``root``; raises where there is none."""
    if not g.directed:
        raise NoTree("an arborescence needs a directed graph")
    local = Local.of(g, max_edges)
    found = kernels.arborescence(local.nodes, local.edges(), root) if root in local.out else None
    if found is None:
        raise NoTree("No arborescence exists")
    return _result(found, "edmonds", root)


def wilson(g: Graph, seed: int = 0, max_edges: int = MAX_EDGES) -> MstResult:
    """A uniform random spanning tree by loop-erased walks; raises if the graph is not connected."""
    _undirected(g)
    found = kernels.random_spanning_tree(Local.of(g, max_edges), random.Random(seed))
    if found is None:
        raise NoTree("the graph is not connected")
    return _result(found, "wilson")


kruskal_int = kruskal_float = kruskal
prim_int = prim_float = prim
boruvka_int = boruvka_float = boruvka
edmonds_int = edmonds_float = edmonds
wilson_int = wilson_float = wilson
