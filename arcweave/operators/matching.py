"""Bipartite graphs, matchings and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators import kernels
from arcweave.operators.contraction import contracted
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.matching_rounds import MatchingRows, bipartite_rows
from arcweave.operators.transform import TooLarge
from arcweave.plans.materialize import materialize


class NotBipartite(ValueError):
    """The graph holds an odd cycle."""


def partition(g: Graph) -> DataFrame | None:
    """(id, side): 0 for the smallest node of each component, ignoring direction; None on an odd cycle.

    Distributed: one pass of components whose edges carry parities both tests and colours.
    """
    sides = contracted(g.edges, "src", "dst", sided=True)
    if not sides.where("odd").isEmpty():
        return None
    return g.nodes.select("id").join(sides.select(F.col("node").alias("id"), "side"), "id", "left").select("id", F.coalesce("side", F.lit(0)).alias("side"))


def is_bipartite(g: Graph) -> bool:
    return partition(g) is not None


def _sides(local: Local) -> dict:
    side = kernels.two_sides(local)
    if side is None:
        raise NotBipartite("the graph is not bipartite")
    return side


def matching_rows(g: Graph) -> MatchingRows:
    """A largest matching of a bipartite graph as rows, with its cover as proof; raises :class:`NotBipartite`."""
    sides = partition(g)
    if sides is None:
        raise NotBipartite("the graph is not bipartite")
    left = materialize(sides.where("side = 0").select(F.col("id").alias("src"), F.lit(True).alias("first")), "left")
    ends = g.edges.select("src", "dst").join(left, "src", "left")
    forward = F.coalesce("first", F.lit(False))
    return bipartite_rows(ends.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("l"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("r")))


def maximum_matching(g: Graph, max_edges: int = MAX_EDGES) -> list[tuple[int, int]]:
    """(left, right) pairs of a largest matching, ascending; raises :class:`TooLarge` beyond ``max_edges`` of them."""
    found = matching_rows(g)
    if found.size > max_edges:
        raise TooLarge(f"a matching of more than {max_edges} pairs is not listed on the driver")
    return sorted((r["l"], r["r"]) for r in found.pairs.collect())


def hopcroft_karp(g: Graph, max_edges: int = MAX_EDGES) -> dict[int, int]:
    """A largest matching of a bipartite graph as a symmetric map."""
    return {a: b for pair in maximum_matching(g, max_edges) for a, b in (pair, pair[::-1])}


def matching_by_component(g: Graph) -> DataFrame:
    """(left, right) of a largest matching."""
    return matching_rows(g).pairs.select(F.col("l").alias("left"), F.col("r").alias("right"))


def hungarian(g: Graph, optimization: str = "min", max_edges: int = MAX_EDGES) -> tuple[object, dict[int, int]]:
    """(cost, symmetric map) of a least (or most, "max") weight assignment of a complete bipartite graph.

    The smaller side is filled up with partners of weight 0.
    """
    local = Local.of(g, max_edges)
    side = _sides(local)
    left, right = [n for n in local.nodes if side[n] == 0], [n for n in local.nodes if side[n] == 1]
    weight = lambda u, v: local.out[u].get(v, local.into[u].get(v))
    if any(weight(u, v) is None for u in left for v in right):
        raise ValueError("the assignment needs an edge between all of left and right")
    n, sign = max(len(left), len(right)), 1 if optimization == "min" else -1
    cost = [[sign * weight(left[i], right[j]) if i < len(left) and j < len(right) else 0 for j in range(n)] for i in range(n)]
    total, columns = kernels.hungarian(cost)
    mate = {}
    for i, j in enumerate(columns):
        if i < len(left) and j < len(right):
            mate[left[i]], mate[right[j]] = right[j], left[i]
    return sign * total, mate


def blossom_maximum_matching(g: Graph, max_edges: int = MAX_EDGES) -> dict[int, int]:
    """A largest matching of any undirected graph as a symmetric map."""
    return kernels.general_matching(Local.of(g, max_edges))


def stable_marriage(left: dict[int, list[int]], right: dict[int, list[int]]) -> dict[int, int]:
    """Left people propose; left to right."""
    return kernels.stable_marriage(left, right)


def get_partner(marriage: dict[int, int], person: int) -> int | None:
    return marriage.get(person)


def stable_marriage_frames(left: DataFrame, right: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(left_id, right_id) from preferences (person, prefs): all free people propose at once, round by round.

    Each round is a join and an aggregate; the outcome is the same as one by one.
    """
    wants = materialize(left.select(F.col("person").alias("l"), F.posexplode("prefs").alias("at", "r")), "wants")
    ranks = materialize(right.select(F.col("person").alias("r"), F.posexplode("prefs").alias("rank", "l")), "ranks")
    state = materialize(left.select(F.col("person").alias("l"), F.lit(0).alias("at")), "proposals")
    for _ in range(max_rounds):
        asked = state.join(wants, ["l", "at"]).join(ranks, ["l", "r"])
        best = asked.groupBy("r").agg(F.min_by("l", "rank").alias("winner"))
        judged = materialize(asked.join(best, "r").select("l", "at", "r", (F.col("l") == F.col("winner")).alias("held")), "judged")
        if judged.where("NOT held").isEmpty():
            return judged.select(F.col("l").alias("left_id"), F.col("r").alias("right_id"))
        state = materialize(judged.select("l", (F.col("at") + (~F.col("held")).cast("int")).alias("at")), "proposals")
    raise RuntimeError("proposals did not settle")
