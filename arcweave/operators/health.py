"""Distances over the whole graph: eccentricity, efficiency, assortativity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators import kernels
from arcweave.operators.centrality import per_source
from arcweave.operators.local import Local
from arcweave.operators.paths import single_source_distances
from arcweave.operators.shortest_counts import distance_sums
from arcweave.operators.transform import subgraph


def eccentricities(g: Graph) -> DataFrame:
    """(id, ecc): the largest distance from each node, null unless all are reached."""
    n = g.order()
    return distance_sums(g).select("id", F.when(F.col("reached") == n, F.col("farthest")).alias("ecc"))


def eccentricity(g: Graph, node: int) -> float | None:
    """The largest distance from ``node``; 0 in a graph of at most one node, None unless all are reached."""
    n = g.order()
    if n <= 1:
        return 0.0
    row = single_source_distances(g, node).agg(F.count("*").alias("n"), F.max("dist").alias("m")).first()
    return float(row["m"]) if row["n"] == n else None


def _extreme(g: Graph, pick) -> float | None:
    row = eccentricities(g).agg(pick("ecc").alias("m"), F.count_if(F.col("ecc").isNull()).alias("none"), F.count("*").alias("n")).first()
    return None if not row["n"] or row["none"] else row["m"]


def diameter(g: Graph) -> float | None:
    """The largest eccentricity; None if the graph is empty or not connected."""
    return _extreme(g, F.max)


def radius(g: Graph) -> float | None:
    return _extreme(g, F.min)


def assortativity(g: Graph) -> float:
    """Correlation of out-degrees over arcs; 0 where it is undefined."""
    arcs = g.arcs()
    out = arcs.groupBy("src").agg(F.count("*").alias("k"))
    zero = F.lit(0)
    x, y = F.coalesce("x", zero).cast("double"), F.coalesce("y", zero).cast("double")
    both = arcs.join(out.select("src", F.col("k").alias("x")), "src", "left").join(out.select(F.col("src").alias("dst"), F.col("k").alias("y")), "dst", "left")
    row = both.agg(F.count("*").alias("m"), F.sum(x * y).alias("xy"), F.sum((x + y) / 2).alias("mean"), F.sum((x * x + y * y) / 2).alias("square")).first()
    if not row["m"]:
        return 0.0
    m, mean = row["m"], row["mean"] / row["m"]
    below = row["square"] / m - mean * mean
    return (row["xy"] / m - mean * mean) / below if below > 1e-15 else 0.0


def average_path_length(g: Graph) -> float | None:
    """Mean distance over ordered pairs; None for at most one node or where some pair is apart."""
    n = g.order()
    if n <= 1:
        return None

    row = distance_sums(g).agg(F.min("reached").alias("n"), F.sum("total").alias("s")).first()
    return row["s"] / (n * (n - 1)) if row["n"] == n else None


def efficiency(g: Graph, u: int, v: int) -> float:
    """1 / distance; 0 for the same node, unreachable ones, or distance 0."""
    if u == v:
        return 0.0
    found = single_source_distances(g, u).where(F.col("id") == v).first()
    return 1 / found["dist"] if found and found["dist"] else 0.0


def _efficiency_of(local: Local) -> float:
    n = len(local.nodes)
    if n < 2:
        return 0.0
    return math.fsum(1 / d for s in local.nodes for d in kernels.dijkstra(local.out, s)[0].values() if d > 0) / (n * (n - 1))


def global_efficiency(g: Graph) -> float:
    n = g.order()
    if n < 2:
        return 0.0
    return (distance_sums(g).agg(F.sum("inverse").alias("e")).first()["e"] or 0.0) / (n * (n - 1))


def local_efficiency(g: Graph, node: int) -> float:
    """Global efficiency among the node's neighbours."""
    near = [r["id"] for r in g.neighbor_ids(node).collect() if r["id"] != node]  # one node's neighbours
    return global_efficiency(subgraph(g, near)) if len(near) > 1 else 0.0


def local_efficiencies(g: Graph) -> DataFrame:
    """(id, score) for all nodes, one ego network at a time in each task."""

    def kernel(local, s):
        yield s, _efficiency_of(local.induced(set(local.near(s)) - {s}))

    return per_source(g, kernel, "id long, score double")


def average_local_efficiency(g: Graph) -> float:
    return local_efficiencies(g).agg(F.avg("score").alias("m")).first()["m"] or 0.0
