"""Cliques, colourings and Euler tours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, canonical, dense_ids
from arcweave.operators import kernels
from arcweave.operators.euler_rounds import listed, tours_exist
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.maximal_cliques import maximal_clique_rows
from arcweave.plans.materialize import materialize, stat


def max_clique(g: Graph, max_edges: int = MAX_EDGES) -> list[int]:
    return list(kernels.max_clique(Local.of(g, max_edges)))


def all_maximal_cliques(g: Graph, max_edges: int = MAX_EDGES) -> list[list[int]]:
    """All maximal cliques; an empty graph has the empty one."""
    return sorted(list(c) for c in kernels.maximal_cliques(Local.of(g, max_edges)))


def maximal_cliques_by_component(g: Graph) -> DataFrame:
    """(clique), a search for each node: see ``maximal_cliques``."""
    return maximal_clique_rows(g)


def k_cliques(g: Graph, k: int) -> DataFrame:
    """(clique): every clique of ``k`` nodes, ascending, by ordered self-joins.

    Edges point from the lower to the higher (degree, id), so a hub's pairs are
    never listed from the hub; each join is semi-joined with the edges at once.
    """
    nodes = g.nodes.select(F.array("id").alias("clique"))
    if k <= 0:
        return nodes.where("false")
    if k == 1:
        return nodes
    edges = canonical(g.edges.where("src <> dst").select("src", "dst"), False).distinct()
    degree = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    s, d = degree.select(F.col("id").alias("src"), F.col("k").alias("ks")), degree.select(F.col("id").alias("dst"), F.col("k").alias("kd"))
    up = (F.col("ks") < F.col("kd")) | ((F.col("ks") == F.col("kd")) & (F.col("src") < F.col("dst")))
    both = edges.join(s, "src").join(d, "dst")
    arcs = materialize(both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")), "arcs")
    found = arcs.select(F.array("a", "b").alias("c"), F.col("a").alias("first"))
    for size in range(3, k + 1):
        grown = found.join(arcs.select(F.col("a").alias("first"), F.col("b").alias("next")), "first")
        for i in range(2, size):
            edge = arcs.select(F.col("a").alias(f"x{i}"), F.col("b").alias("next"))
            grown = grown.withColumn(f"x{i}", F.element_at("c", i)).join(edge, [f"x{i}", "next"], "left_semi")
        found = materialize(grown.select(F.concat("c", F.array("next")).alias("c"), "first"), "cliques")
    return found.select(F.array_sort("c").alias("clique"))


def triangles(g: Graph) -> DataFrame:
    return k_cliques(g, 3)


@dataclass(frozen=True)
class Coloring:
    count: int
    colors: dict[int, int]
    proved: bool = True


def coloring_greedy(g: Graph, max_edges: int = MAX_EDGES) -> Coloring:
    """Colours from 1, nodes by falling degree then id."""
    c = kernels.greedy_colors(Local.of(g, max_edges))
    return Coloring(max(c.values(), default=0), c, False)


def coloring_dsatur(g: Graph, max_edges: int = MAX_EDGES) -> Coloring:
    """Colours from 1, always the node with most colours around it."""
    c = kernels.dsatur(Local.of(g, max_edges))
    return Coloring(max(c.values(), default=0), c, False)


def coloring_exact(g: Graph, timeout_ms: int = 5000, max_edges: int = MAX_EDGES) -> Coloring:
    """Fewest colours; ``proved`` is False if time ran out on the best found."""
    c, proved = kernels.exact_colors(Local.of(g, max_edges), timeout_ms / 1000)
    return Coloring(max(c.values(), default=0), c, proved)


def color_parallel(g: Graph, seed: int = 0, max_rounds: int = 10_000) -> DataFrame:
    """(id, color): a proper colouring by distributed rounds.

    In each round the uncoloured nodes whose (hash, id) is largest among their
    uncoloured neighbours take their smallest free colour.
    """
    arcs = materialize(g.arcs().where("src <> dst").select("src", "dst").union(g.arcs().where("src <> dst").select("dst", "src")).distinct(), "arcs")
    state = materialize(g.nodes.select("id", F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id").alias("i")).alias("p"), F.lit(None).cast("int").alias("color")), "colors")
    left = None
    for _ in range(max_rounds):
        if left == 0 or left is None and state.isEmpty():
            return state.select("id", "color")
        near = arcs.join(state.select(F.col("id").alias("dst"), "p", "color"), "dst").groupBy(F.col("src").alias("id")).agg(
            F.max(F.when(F.col("color").isNull(), F.col("p"))).alias("top"), F.collect_set("color").alias("used")
        )
        free = F.expr("element_at(array_except(sequence(1, size(used) + 1), used), 1)")
        both = state.join(near, "id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
        turn = F.col("color").isNull() & (F.col("top").isNull() | (F.col("p") > F.col("top")))
        state = materialize(both.select("id", "p", F.when(turn, free).otherwise(F.col("color")).alias("color")), "colors", left=F.count_if(F.col("color").isNull()))
        left = stat(state, "left")
    raise RuntimeError("colours did not settle")


def _numbered(g: Graph) -> DataFrame:
    """(edge, src, dst): the edges numbered in order of their ends."""
    return dense_ids(g.edges.select("src", "dst", F.struct("src", "dst").alias("key")), "key", "edge").select("edge", "src", "dst")


def has_eulerian_circuit(g: Graph) -> bool:
    """Even or balanced degrees and one component, isolated nodes aside; false without edges."""
    return tours_exist(g.edges, g.directed)[0]


def has_eulerian_path(g: Graph) -> bool:
    return tours_exist(g.edges, g.directed)[1]


def _walk(g: Graph, closed: bool, max_edges: int) -> list[int] | None:
    rows = listed(_numbered(g), g.directed, closed, max_edges)
    return None if rows is None else [rows[0]["src"], *(r["dst"] for r in rows)]


def find_eulerian_circuit(g: Graph, max_edges: int = MAX_EDGES) -> list[int] | None:
    """Nodes in walking order, from ``euler_rounds``."""
    return _walk(g, True, max_edges)


def find_eulerian_path(g: Graph, max_edges: int = MAX_EDGES) -> list[int] | None:
    return _walk(g, False, max_edges)


def euler_degrees(g: Graph) -> DataFrame:
    """(odd, surplus, deficit): node counts that decide on Euler tours, relationally."""
    d = g.degrees()
    gap = F.col("out_degree") - F.col("in_degree")
    return d.agg(F.count_if(F.col("degree") % 2 == 1).alias("odd"), F.count_if(gap == 1).alias("surplus"), F.count_if(gap == -1).alias("deficit"))
