"""Shortest and widest paths.

Distances from one or many sources are relational relaxation rounds: only
improved rows spread, each round is a join with the arcs and a partial
aggregate.  Paths are rows of ``path_tables``.  Searches from both ends,
deviations and heuristics are kernels behind a size guard.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.semirings import MAX_MIN, MIN_PLUS, Semiring
from arcweave.model import Graph, node_frame
from arcweave.operators import kernels
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.plans.fixpoint import relax
from arcweave.plans.materialize import materialize


class NegativeCycle(ValueError):
    """Distances have no end: a cycle of negative weight is reachable."""


@dataclass(frozen=True)
class Path:
    nodes: list[int]
    total_weight: object


def distances_from(g: Graph, sources: DataFrame, semiring: Semiring = MIN_PLUS, max_rounds: int | None = None) -> DataFrame:
    """(src, dst, dist) from every row of ``sources`` (id) to what it reaches.

    The number of rounds is that of the longest best path, at most the node
    count; beyond it a negative cycle is at work.
    """
    arcs = materialize(g.arcs(), "arcs")
    kind = arcs.schema["w"].dataType
    start = F.lit(semiring.start).cast(kind) if semiring.start is not None else F.lit(None).cast(kind)
    first = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), start.alias("dist"), F.lit(True).alias("fresh")).distinct()
    step = arcs.select(F.col("src").alias("mid"), F.col("dst").alias("to"), "w")

    def spread(fresh):
        dist = F.when(F.col("dist").isNull(), F.col("w")).otherwise(semiring.extend(F.col("dist"), F.col("w")))
        out = fresh.join(step, fresh["dst"] == step["mid"]).select("src", F.col("to").alias("dst"), dist.alias("dist"))
        return out.groupBy("src", "dst").agg(semiring.best("dist").alias("new"))

    def merged(state, new):
        at_start = F.col("src") == F.col("dst") if semiring.start is None else F.lit(False)
        unknown = F.col("fresh").isNull()
        better = F.col("new").isNotNull() & ~F.coalesce(at_start, F.lit(False)) & (unknown | F.coalesce(semiring.better(F.col("new"), F.col("dist")), F.lit(False)))
        better = F.coalesce(better, F.lit(False))
        return state.join(new, ["src", "dst"], "full_outer").select("src", "dst", F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"), better.alias("fresh"))

    bound = max_rounds if max_rounds is not None else g.order() + 1
    state, settled = relax(materialize(first, "dist"), spread, merged, bound, "dist")
    if not settled:
        raise NegativeCycle("a cycle of negative weight is reachable")
    return state.select("src", "dst", "dist")


def single_source_distances(g: Graph, source: int, semiring: Semiring = MIN_PLUS) -> DataFrame:
    """(id, dist) of all nodes that ``source`` reaches; the source itself is at 0, even if absent."""
    return distances_from(g, node_frame([(source, None)]).select("id"), semiring).select(F.col("dst").alias("id"), "dist")


single_source_distances_int = single_source_distances_float = single_source_distances


def _one_path(g: Graph, start: int, goal: int, semiring: Semiring) -> Path | None:
    """The path of :func:`path_tables.shortest_path_rows` from ``start`` to ``goal``; only its own nodes come to the driver."""
    from arcweave.operators.path_tables import shortest_path_rows

    pair = node_frame([(start, None)]).select(F.col("id").alias("src"), F.lit(goal).cast("long").alias("dst"))
    rows = sorted(shortest_path_rows(g, pair, semiring).select("position", "node", "dist").collect())
    return Path([r["node"] for r in rows], rows[-1]["dist"]) if rows else None


def shortest_path(g: Graph, start: int, goal: int) -> Path | None:
    """A least-weight path: fewest hops among those, then smaller parents; start = goal is a path even if absent."""
    return Path([start], 0) if start == goal else _one_path(g, start, goal, MIN_PLUS)


shortest_path_int = shortest_path_float = shortest_path


def widest_path(g: Graph, start: int, goal: int) -> Path | None:
    """A path whose least weight is largest, and so are those of its beginnings."""
    return Path([start], float("inf")) if start == goal else _one_path(g, start, goal, MAX_MIN)


widest_path_int = widest_path


def widest_distances(g: Graph, source: int) -> DataFrame:
    """(id, dist): the width of the widest path from ``source`` to each other node, relationally."""
    return single_source_distances(g, source, MAX_MIN).where(F.col("id") != source)


def implicit_dijkstra_by(start, successors, is_goal, key):
    """Cost of the cheapest state that ``is_goal`` accepts, or None; states of one key count once."""
    return implicit_a_star_by(start, successors, is_goal, lambda s: 0, key)


def implicit_dijkstra(start, successors, is_goal):
    return implicit_dijkstra_by(start, successors, is_goal, lambda s: s)


def bidirectional(g: Graph, start: int, goal: int, max_edges: int = MAX_EDGES) -> Path | None:
    """A least-weight path met from both ends."""
    found = kernels.bidirectional(Local.of(g, max_edges), start, goal)
    return None if found is None else Path(*found)


bidirectional_int = bidirectional_float = bidirectional


def bidirectional_unweighted(g: Graph, start: int, goal: int, max_edges: int = MAX_EDGES) -> Path | None:
    """A path of fewest hops met from both ends; None if an end is absent."""
    local = Local.of(g, max_edges)
    if start not in local.out or goal not in local.out:
        return None
    found = kernels.bidirectional(local, start, goal, unweighted=True)
    return None if found is None else Path(*found)


def a_star(g: Graph, start: int, goal: int, heuristic: Callable[[int, int], float], max_edges: int = MAX_EDGES) -> Path | None:
    found = kernels.shortest_path(Local.of(g, max_edges).out, start, goal, heuristic=lambda n: heuristic(n, goal))
    return None if found is None else Path(*found)


a_star_int = a_star_float = a_star


def implicit_a_star_by(start, successors: Callable[[object], Iterable[tuple[object, float]]], is_goal: Callable[[object], bool], heuristic, key):
    best, heap, tick = {key(start): 0}, [(heuristic(start), 0, 0, start)], 0
    while heap:
        _, _, cost, state = heapq.heappop(heap)
        if cost > best[key(state)]:
            continue
        if is_goal(state):
            return cost
        for s, c in successors(state):
            k = key(s)
            if k not in best or cost + c < best[k]:
                best[k], tick = cost + c, tick + 1
                heapq.heappush(heap, (cost + c + heuristic(s), tick, cost + c, s))
    return None


def implicit_a_star(start, successors, is_goal, heuristic):
    return implicit_a_star_by(start, successors, is_goal, heuristic, lambda s: s)


def bellman_ford(g: Graph, start: int, goal: int) -> tuple[str, Path | None]:
    """("shortest_path", path), ("negative_cycle", None) or ("no_path", None); a cycle counts where ``start`` reaches it."""
    try:
        found = _one_path(g, start, goal, MIN_PLUS)
    except NegativeCycle:
        return "negative_cycle", None
    return ("shortest_path", found) if found else ("no_path", None)


bellman_ford_int = bellman_ford_float = bellman_ford


def implicit_bellman_ford_by(start, successors, is_goal, key):
    """("found_goal", cost), ("negative_cycle", None) or ("no_goal", None) over a state space."""
    from collections import deque

    best, held, relaxed, queue, waiting = {key(start): 0}, {key(start): start}, {}, deque([key(start)]), {key(start)}
    while queue:
        k = queue.popleft()
        waiting.discard(k)
        for s, c in successors(held[k]):
            j = key(s)
            if j not in best or best[k] + c < best[j]:
                best[j], held[j] = best[k] + c, s
                relaxed[j] = relaxed.get(j, 0) + 1
                if relaxed[j] > len(best):
                    return "negative_cycle", None
                if j not in waiting:
                    waiting.add(j)
                    queue.append(j)
    goals = [best[k] for k, s in held.items() if is_goal(s)]
    return ("found_goal", min(goals)) if goals else ("no_goal", None)


def implicit_bellman_ford(start, successors, is_goal):
    return implicit_bellman_ford_by(start, successors, is_goal, lambda s: s)


def all_pairs(g: Graph) -> DataFrame:
    """(src, dst, dist) of all reachable pairs, a node at 0 from itself; raises on a negative cycle.

    Paths double each round: a min-plus self-join of what is known and an
    aggregate.  The result is quadratic by nature.
    """
    zero = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).cast(g.edges.schema["w"].dataType).alias("w"))
    held = materialize(g.arcs().unionByName(zero).groupBy("src", "dst").agg(F.min("w").alias("w")), "pairs")
    reach, n = 1, g.order()
    while reach <= 2 * n:
        if not held.where("src = dst AND w < 0").isEmpty():
            raise NegativeCycle("a cycle of negative weight is reachable")
        a, b = held.alias("a"), held.alias("b")
        new = a.join(b, F.col("a.dst") == F.col("b.src")).groupBy(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).agg(F.min(F.col("a.w") + F.col("b.w")).alias("w"))
        new = materialize(new, "pairs")
        same = new.join(held.withColumnRenamed("w", "old"), ["src", "dst"], "left").where("old IS NULL OR w < old").isEmpty()
        held, reach = new, reach * 2
        if same:
            break
    return held.select("src", "dst", F.col("w").alias("dist"))


floyd_warshall = floyd_warshall_int = floyd_warshall_float = all_pairs
johnson = johnson_int = johnson_float = all_pairs


def detect_negative_cycle(g: Graph) -> bool:
    try:
        all_pairs(g)
    except NegativeCycle:
        return True
    return False


def distance_matrix(g: Graph, points: Iterable[int]) -> DataFrame:
    """(src, dst, dist) among ``points``; unreachable pairs are absent."""
    ids = node_frame([(p, None) for p in points]).select("id")
    ids = ids.join(g.nodes.select("id"), "id", "left_semi")
    return distances_from(g, ids).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "dist")


distance_matrix_int = distance_matrix_float = distance_matrix


def k_shortest_paths(g: Graph, start: int, goal: int, k: int, max_edges: int = MAX_EDGES) -> list[Path] | None:
    """Up to ``k`` loopless paths by weight; None if k < 1 or there is no path."""
    found = kernels.k_shortest_paths(Local.of(g, max_edges), start, goal, k)
    return None if found is None else [Path(*p) for p in found]


k_shortest_paths_int = k_shortest_paths_float = k_shortest_paths


class NotATree(ValueError):
    """The graph below the root isn't a tree, or the root is absent."""


@dataclass(frozen=True)
class LcaState:
    """(node, ancestor, distance) rows of a rooted tree, the node its own ancestor at 0."""

    ancestors: DataFrame
    depth: DataFrame


def lca_preprocess(g: Graph, root: int) -> LcaState:
    """Ancestors of every node by doubling: each round joins the known chains with themselves."""
    from arcweave.operators.traversal import bfs_levels

    if not g.has_node(root):
        raise NotATree(f"root {root} is absent")
    tree = materialize(bfs_levels(g, root), "tree")
    n, e = g.order(), g.edges.where("src <> dst").count()
    if tree.count() != n or e != n - 1 or g.edges.count() != e:
        raise NotATree("the graph is not a tree below the root")
    steps = materialize(tree.where("parent IS NOT NULL").select(F.col("id").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "steps")
    chains, span = steps, 1
    deepest = tree.agg(F.max("depth").alias("m")).first()["m"] or 0
    while span < deepest:
        a, b = chains.alias("a"), chains.alias("b")
        far = a.join(b, F.col("a.ancestor") == F.col("b.node")).where(F.col("a.distance") == span).select(
            F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance")
        )
        chains, span = materialize(chains.unionByName(far), "chains"), span * 2
    own = tree.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    return LcaState(chains.unionByName(own), tree.select("id", "depth"))


def lca_pairs(state: LcaState, pairs: DataFrame) -> DataFrame:
    """(a, b, lca, distance) for each row of ``pairs`` (a, b): the common ancestor nearest to both."""
    x = state.ancestors.select(F.col("node").alias("a"), "ancestor", F.col("distance").alias("da"))
    y = state.ancestors.select(F.col("node").alias("b"), F.col("ancestor").alias("other"), F.col("distance").alias("db"))
    met = pairs.distinct().join(x, "a").join(y, "b").where("ancestor = other")
    return met.groupBy("a", "b").agg(F.min_by("ancestor", F.col("da") + F.col("db")).alias("lca"), F.min(F.col("da") + F.col("db")).alias("distance"))


def lca(state: LcaState, a: int, b: int) -> int | None:
    row = lca_pairs(state, _pair(a, b)).first()
    return None if row is None else row["lca"]


def tree_distance(state: LcaState, a: int, b: int) -> int | None:
    row = lca_pairs(state, _pair(a, b)).first()
    return None if row is None else row["distance"]


def _pair(a: int, b: int) -> DataFrame:
    return node_frame([(a, str(b))]).select(F.col("id").alias("a"), F.col("data").cast("long").alias("b"))


def chinese_postman(g: Graph, max_edges: int = MAX_EDGES) -> Path | None:
    """The least closed walk over all edges of a connected undirected graph."""
    found = kernels.chinese_postman(Local.of(g, max_edges))
    return None if found is None else Path(*found)


chinese_postman_int = chinese_postman_float = chinese_postman
