"""Projections, filters and reshaping of graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.model import Combine, Graph, canonical, combined, dense_ids, last_wins, node_frame
from arcweave.plans.materialize import materialize, stat


def transpose(g: Graph) -> Graph:
    if not g.directed:
        return g
    return g.with_edges(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def map_nodes(g: Graph, f: Callable[[Column], Column]) -> Graph:
    return g.with_nodes(g.nodes.select("id", f(F.col("data")).alias("data")))


def map_nodes_indexed(g: Graph, f: Callable[[Column, Column], Column]) -> Graph:
    return g.with_nodes(g.nodes.select("id", f(F.col("id"), F.col("data")).alias("data")))


def map_edges(g: Graph, f: Callable[[Column], Column]) -> Graph:
    return g.with_edges(g.edges.select("src", "dst", f(F.col("w")).alias("w")))


def map_edges_indexed(g: Graph, f: Callable[[Column, Column, Column], Column]) -> Graph:
    return g.with_edges(g.edges.select("src", "dst", f(F.col("src"), F.col("dst"), F.col("w")).alias("w")))


def induced(g: Graph, ids: DataFrame) -> Graph:
    """The subgraph induced by ``ids`` (id)."""
    ids = ids.select("id").distinct()
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(g.nodes.join(ids, "id", "left_semi"), edges.select("src", "dst", "w"), g.directed)


def subgraph(g: Graph, ids: Iterable[int]) -> Graph:
    return induced(g, node_frame([(i, None) for i in ids]))


def filter_nodes(g: Graph, predicate: Callable[[Column], Column]) -> Graph:
    return induced(g, g.nodes.where(predicate(F.col("data"))))


def filter_edges(g: Graph, predicate: Callable[[Column, Column, Column], Column]) -> Graph:
    return g.with_edges(g.edges.where(predicate(F.col("src"), F.col("dst"), F.col("w"))))


class TooLarge(ValueError):
    """A result would grow with the square of the nodes beyond the allowed bound."""


def _guard(g: Graph, bound: int) -> None:
    n = g.order()
    if n * n > bound:
        raise TooLarge(f"{n} nodes give up to {n * n} pairs; the bound is {bound}")


def complement(g: Graph, default: object = 1, max_pairs: int = 10**9) -> Graph:
    """All pairs of different nodes that aren't adjacent; quadratic by nature, so guarded."""
    _guard(g, max_pairs)
    a, b = g.nodes.select(F.col("id").alias("src")), g.nodes.select(F.col("id").alias("dst"))
    pairs = a.join(b, F.col("src") != F.col("dst") if g.directed else F.col("src") < F.col("dst"))
    return g.with_edges(pairs.join(g.edges, ["src", "dst"], "left_anti").withColumn("w", F.lit(default)))


def merge(base: Graph, other: Graph) -> Graph:
    """Nodes and edges of both; where both have one, that of ``other``."""
    theirs = canonical(other.arcs() if base.directed else other.edges, base.directed).dropDuplicates(["src", "dst"])
    nodes = base.nodes.join(other.nodes, "id", "left_anti").unionByName(other.nodes)
    edges = base.edges.join(theirs, ["src", "dst"], "left_anti").unionByName(theirs)
    return Graph(nodes, edges, base.directed)


def contract(g: Graph, a: int, b: int, combine: str | Combine = "sum") -> Graph:
    """Merge node b into a; parallel edges combine, edges between the two and loops at b go."""
    gone = ((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a)) | ((F.col("src") == b) & (F.col("dst") == b))
    moved = F.when(F.col("src") == b, 1).when(F.col("dst") == b, 1).otherwise(0)
    here = lambda c: F.when(F.col(c) == b, F.lit(a).cast("long")).otherwise(F.col(c)).alias(c)
    edges = canonical(g.edges.where(~gone).select(here("src"), here("dst"), "w", moved.alias("_moved")), g.directed)
    edges = edges.groupBy("src", "dst").agg(combined("w", combine, F.col("_moved")).alias("w"))
    return Graph(g.nodes.where(F.col("id") != b), edges, g.directed)


def to_directed(g: Graph) -> Graph:
    return Graph(g.nodes, g.arcs(), True)


def to_undirected(g: Graph, resolve: str | Combine = "min") -> Graph:
    """One edge for each pair; where both directions exist, ``resolve`` (the one from the smaller node first)."""
    if not g.directed:
        return g
    turned = (F.col("src") > F.col("dst")).cast("int")
    edges = canonical(g.edges.select("src", "dst", "w", turned.alias("_turned")), False)
    return Graph(g.nodes, edges.groupBy("src", "dst").agg(combined("w", resolve, F.col("_turned")).alias("w")), False)


def update_node(g: Graph, node: int, default: object, f: Callable[[Column], Column]) -> Graph:
    """Apply ``f`` to a node's payload, or add the node with ``default``."""
    nodes = g.nodes.select("id", F.when(F.col("id") == node, f(F.col("data"))).otherwise(F.col("data")).alias("data"))
    return g.with_nodes(nodes).add_missing([node], default)


def update_edge(g: Graph, src: int, dst: int, default: object, f: Callable[[Column], Column]) -> Graph:
    """Apply ``f`` to an edge's weight, or add the edge with ``default``; nothing if an end is absent."""
    if g.try_add_edge(src, dst, default)[0] is None:
        return g
    if not g.has_edge(src, dst):
        return g.add_edge(src, dst, default)
    s, d = (src, dst) if g.directed else (min(src, dst), max(src, dst))
    this = (F.col("src") == s) & (F.col("dst") == d)
    return g.with_edges(g.edges.select("src", "dst", F.when(this, f(F.col("w"))).otherwise(F.col("w")).alias("w")))


def add_self_loops(g: Graph, default: object = 1) -> Graph:
    loops = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).join(g.edges, ["src", "dst"], "left_anti")
    return g.with_edges(g.edges.unionByName(loops.withColumn("w", F.lit(default))))


def remove_self_loops(g: Graph) -> Graph:
    return g.with_edges(g.edges.where("src <> dst"))


def relabel(g: Graph, f: Callable[[Column], Column]) -> Graph:
    """id := f(id); where ids meet, the one with the larger old id wins."""
    nodes = last_wins(g.nodes.select(f(F.col("id")).cast("long").alias("id"), "data", F.col("id").alias("_old")), ["id"], "_old")
    edges = canonical(
        g.edges.select(f(F.col("src")).cast("long").alias("src"), f(F.col("dst")).cast("long").alias("dst"), "w", F.struct("src", "dst").alias("_old")),
        g.directed,
    )
    return Graph(nodes, last_wins(edges, ["src", "dst"], "_old"), g.directed)


relabel_nodes = relabel


def normalize_node_ids(g: Graph) -> Graph:
    """Ids 0 .. n-1 by ascending old id."""
    ids = materialize(dense_ids(g.nodes, "id", "new"), "ids")
    nodes = ids.select(F.col("new").alias("id"), "data")
    s = ids.select(F.col("id").alias("src"), F.col("new").alias("s"))
    d = ids.select(F.col("id").alias("dst"), F.col("new").alias("d"))
    edges = g.edges.join(s, "src").join(d, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")
    return Graph(nodes, edges, g.directed)


def ego_graph(g: Graph, node: int, radius: int, mode: str = "successors") -> Graph:
    """The subgraph induced by what lies within ``radius`` hops; mode: successors or neighbors."""
    from arcweave.operators.traversal import levels

    if radius < 0:
        raise ValueError("a radius is not negative")
    arcs = g.arcs() if mode == "successors" else g.neighbor_frame()
    seeds = g.nodes.where(F.col("id") == node).select("id")
    return induced(g, levels(arcs, seeds, radius).select("id"))


def quotient_graph(g: Graph, partition: DataFrame, combine_weight: str | Combine = "sum", combine_data: str | Combine = "sum") -> Graph:
    """Blocks of ``partition`` (id, block) as nodes; nodes without one are their own, edges within a block go."""
    block = partition.select(F.col("id").alias("_id"), "block")

    def of(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(block, F.col(column) == F.col("_id"), "left").withColumn(out, F.coalesce("block", column)).drop("_id", "block")

    nodes = of(g.nodes, "id", "_b").groupBy(F.col("_b").alias("_k")).agg(combined("data", combine_data, F.col("id")).alias("data"))
    moved = of(of(g.edges, "src", "_s"), "dst", "_d").where("_s <> _d")
    moved = moved.withColumn("_o", F.struct("src", "dst")).drop("src", "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w", "_o")
    edges = canonical(moved, g.directed).groupBy("src", "dst").agg(combined("w", combine_weight, F.col("_o")).alias("w"))
    return Graph(nodes.withColumnRenamed("_k", "id"), edges, g.directed)


def transitive_closure(g: Graph, combine: str = "min", max_rounds: int = 64) -> Graph:
    """An edge for every pair joined by a path; members of a cycle get loops.

    Paths double each round.  Weights: "min" the least sum along a path, "max"
    the largest (on acyclic graphs).
    """
    if combine not in ("min", "max"):
        raise ValueError("closure weights are combined by min or max")
    pick = F.min if combine == "min" else F.max
    seen = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("src", "dst", "w").cast("decimal(38,0)"))}
    count = lambda df: (stat(df, "n"), stat(df, "s"))
    held = materialize(g.arcs().groupBy("src", "dst").agg(pick("w").alias("w")), "closure", **seen)
    before = count(held)
    for _ in range(max_rounds):
        a, b = held.alias("a"), held.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), (F.col("a.w") + F.col("b.w")).alias("w"))
        held = materialize(held.unionByName(longer).groupBy("src", "dst").agg(pick("w").alias("w")), "closure", **seen)
        after = count(held)
        if after == before:
            return Graph(g.nodes, canonical(held, g.directed).dropDuplicates(["src", "dst"]), g.directed)
        before = after
    raise RuntimeError("the closure did not settle; max needs an acyclic graph, min one without negative cycles")


def transitive_reduction(g: Graph) -> Graph:
    """Drop u -> v where another successor of u reaches v."""
    reach = transitive_closure(g.with_edges(g.edges.withColumn("w", F.lit(1).cast("long")))).edges
    a, b, r = g.edges.alias("a"), g.edges.alias("b"), reach.alias("r")
    spare = (
        a.join(b, (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") != F.col("b.dst")))
        .join(r, (F.col("b.dst") == F.col("r.src")) & (F.col("r.dst") == F.col("a.dst")))
        .select(F.col("a.src").alias("src"), F.col("a.dst").alias("dst")).distinct()
    )
    return g.with_edges(g.edges.join(spare, ["src", "dst"], "left_anti"))
