"""Sampled estimates and approximations; every sample takes a seed."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, canonical
from arcweave.operators import kernels
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.paths import distances_from
from arcweave.operators.planarity import tree_decomposition, treewidth_upper_bound  # noqa: F401
from arcweave.operators.shortest_counts import dependencies
from arcweave.operators.transform import transpose
from arcweave.plans.materialize import materialize, stat


def pivots(g: Graph, k: int, seed: int = 0) -> DataFrame:
    """(id) of ``k`` nodes by least hash with the seed."""
    return g.nodes.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k)


def diameter(g: Graph, samples: int = 4, seed: int = 0) -> float | None:
    """A lower bound: from each of ``samples`` nodes to the farthest, and from there again; None if the graph is empty."""
    farthest = lambda ids: distances_from(g, ids).groupBy("src").agg(F.max(F.struct("dist", (-F.col("dst")).alias("node"))).alias("x"))
    first = materialize(farthest(pivots(g, samples, seed)).select((-F.col("x.node")).alias("id"), F.col("x.dist").alias("d")), "sweep")
    second = farthest(first.select("id").distinct()).select(F.col("x.dist").alias("d"))
    row = first.select("d").union(second).agg(F.max(F.col("d").cast("double")).alias("m")).first()
    return row["m"]


diameter_unweighted = diameter


def betweenness(g: Graph, samples: int | None = None, seed: int = 0, weighted: bool = True) -> DataFrame:
    """Dependencies of sampled sources, scaled to all."""
    n = g.order()
    k = max(1, min(n, samples or math.isqrt(n)))
    sums = dependencies(g, pivots(g, k, seed), weighted)
    scale = (n / k) * (1.0 if g.directed else 0.5)
    return g.nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("score"))


def _to_pivots(g: Graph, samples: int | None, seed: int) -> tuple[DataFrame, int, int]:
    n = g.order()
    k = max(1, min(n, samples or math.isqrt(n)))
    rows = distances_from(transpose(g), pivots(g, k, seed))
    return rows.select(F.col("src").alias("pivot"), F.col("dst").alias("id"), F.col("dist").cast("double").alias("dist")), n, k


def closeness(g: Graph, samples: int | None = None, seed: int = 0) -> DataFrame:
    """From distances to pivots: s (n - 1) / (n * sum); 0 if some pivot is not reached."""
    rows, n, k = _to_pivots(g, samples, seed)
    sums = rows.groupBy("id").agg(F.count("*").alias("c"), F.sum("dist").alias("s"))
    score = F.when((F.col("c") == k) & (F.col("s") > 0), F.lit(k * (n - 1.0) / max(1, n)) / F.col("s")).otherwise(0.0)
    return g.nodes.select("id").join(sums, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def harmonic(g: Graph, samples: int | None = None, seed: int = 0) -> DataFrame:
    rows, n, k = _to_pivots(g, samples, seed)
    sums = rows.where("dist > 0").groupBy("id").agg(F.sum(1 / F.col("dist")).alias("s"))
    return g.nodes.select("id").join(sums, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) * (n / (k * max(1, n - 1)))).alias("score"))


def average_path_length(g: Graph, samples: int | None = None, seed: int = 0) -> float | None:
    """Mean over reachable pairs of sampled sources; 0 for at most one node."""
    n = g.order()
    if n <= 1:
        return 0.0
    rows, _, _ = _to_pivots(g, samples, seed)
    return rows.where("pivot <> id").agg(F.avg("dist").alias("m")).first()["m"]


def global_efficiency(g: Graph, samples: int | None = None, seed: int = 0) -> float:
    n = g.order()
    if n <= 1:
        return 0.0
    rows, n, k = _to_pivots(g, samples, seed)
    return (rows.where("dist > 0").agg(F.sum(1 / F.col("dist")).alias("s")).first()["s"] or 0.0) / (k * (n - 1))


def transitivity(g: Graph, samples: int | None = None, seed: int = 0, max_edges: int = MAX_EDGES) -> float:
    """The share of closed wedges among sampled ones, wedges drawn evenly."""
    local, r = Local.of(g, max_edges), random.Random(seed)
    near = {n: [v for v in local.near(n) if v != n] for n in local.nodes}
    middles = [n for n in local.nodes if len(near[n]) > 1]
    if not middles:
        return 0.0
    k = samples or min(10_000, len(local.nodes) ** 2)
    wedges = [len(near[n]) * (len(near[n]) - 1) / 2 for n in middles]
    closed = 0
    for n in r.choices(middles, wedges, k=k):
        u, v = r.sample(near[n], 2)
        closed += v in local.out[u] or u in local.out[v]
    return closed / k


def transitivity_exact(g: Graph) -> float:
    """Closed over all wedges, from triangles and degrees, relationally."""
    from arcweave.operators.cliques import triangles

    edges = canonical(g.edges.where("src <> dst").select("src", "dst"), False).distinct()
    d = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    wedges = d.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("w")).first()["w"] or 0
    return 3 * triangles(g).count() / wedges if wedges else 0.0


def vertex_cover(g: Graph, max_edges: int = MAX_EDGES) -> set[int]:
    """Both ends of a greedy maximal matching in edge order: at most twice the least cover."""
    cover: set[int] = set()
    for u, v, _ in Local.of(g, max_edges).edges():
        if u not in cover and v not in cover:
            cover |= {u, v}
    return cover


def vertex_cover_parallel(g: Graph, seed: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """(id) of a cover at most twice the least one, from a maximal matching found in distributed rounds.

    In each round the edges that are least by hash at both ends are matched.
    """
    edges = materialize(canonical(g.edges.select("src", "dst"), False).distinct().withColumn("h", F.xxhash64("src", "dst", F.lit(seed))), "edges")
    cover, left = None, None
    for _ in range(max_rounds):
        if left == 0 or left is None and edges.isEmpty():
            break
        best = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), F.struct("h", "src", "dst").alias("e")).groupBy("id").agg(F.min("e").alias("e"))
        both = best.groupBy("e").agg(F.count("*").alias("n")).where((F.col("n") == 2) | (F.col("e.src") == F.col("e.dst")))
        ends = materialize(both.select(F.explode(F.array_distinct(F.array("e.src", "e.dst"))).alias("id")).distinct(), "cover")
        cover = ends if cover is None else cover.unionByName(ends)
        gone = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_anti").join(ends.withColumnRenamed("id", "dst"), "dst", "left_anti")
        edges = materialize(gone.select("src", "dst", "h"), "edges", n=F.count(F.lit(1)))
        left = stat(edges, "n")
    return cover if cover is not None else g.nodes.select("id").where("false")


def max_clique(g: Graph, max_edges: int = MAX_EDGES) -> list[int]:
    """A clique grown greedily by degree from every start, the largest of them."""
    local = Local.of(g, max_edges)
    near = {n: set(local.near(n)) - {n} for n in local.nodes}
    best: list[int] = []
    for s in sorted(local.nodes, key=lambda n: (-len(near[n]), n)):
        if len(near[s]) < len(best):
            break
        clique, allowed = [s], set(near[s])
        while allowed:
            v = max(allowed, key=lambda n: (len(near[n]), -n))
            clique.append(v)
            allowed &= near[v]
        if len(clique) > len(best):
            best = sorted(clique)
    return best
