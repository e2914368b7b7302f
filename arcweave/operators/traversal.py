"""Walks over graphs: breadth-first levels as relational rounds, orders as kernels."""

from __future__ import annotations

import heapq
import random
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators import kernels
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.plans.materialize import materialize, stat

CONTINUE, STOP, HALT = "continue", "stop", "halt"


@dataclass(frozen=True)
class WalkMetadata:
    depth: int
    parent: int | None


def levels(arcs: DataFrame, seeds: DataFrame, radius: int | None = None) -> DataFrame:
    """(id, depth, parent) of all nodes within ``radius`` hops of ``seeds`` (id).

    The parent is the smallest node of the level before.  Each round joins the
    newest level with the arcs and anti-joins what is known.
    """
    arcs = arcs.select("src", "dst")
    known = materialize(seeds.select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")).distinct(), "levels")
    front, depth = known, 0
    while radius is None or depth < radius:
        depth += 1
        grown = front.join(arcs, front["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = materialize(grown.join(known, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"), "levels", n=F.count(F.lit(1)))
        if not stat(front, "n"):
            break
        known = known.unionByName(front)
        if depth % 8 == 0:
            known = materialize(known, "levels")
    return known


def bfs_levels(g: Graph, start: int, radius: int | None = None) -> DataFrame:
    """(id, depth, parent) of what ``start`` reaches."""
    return levels(g.arcs(), g.nodes.where(F.col("id") == start).select("id"), radius)


def topological_generations(g: Graph) -> tuple[DataFrame, bool]:
    """((id, generation), acyclic): layers of nodes without predecessors left, by removal rounds."""
    arcs = g.arcs().select("src", "dst")
    need = g.nodes.select("id").join(arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need")), "id", "left")
    counts = {"free": F.count_if(F.col("need") == 0), "bound": F.count_if(F.col("need") > 0)}
    table = materialize(need.select("id", F.coalesce("need", F.lit(0)).alias("need")), "need", **counts)
    done, depth = table.where("need = 0").select("id", F.lit(0).alias("generation")), 0
    front, left = done, table.where("need > 0")
    while stat(table, "free") and stat(table, "bound"):
        depth += 1
        freed = front.join(arcs, front["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
        table = materialize(left.join(freed, "id", "left").select("id", (F.col("need") - F.coalesce("n", F.lit(0))).alias("need")), "need", **counts)
        front = table.where("need = 0").select("id", F.lit(depth).alias("generation"))
        left = table.where("need > 0")
        done = done.unionByName(front)
        if depth % 8 == 0:
            done = materialize(done, "generation")
    return done, not stat(table, "bound")


def is_acyclic(g: Graph) -> bool:
    """Directed: removal rounds leave nothing; undirected: as many edges as nodes less components, and no loop."""
    if g.directed:
        return topological_generations(g)[1]
    from arcweave.operators.connectivity import weakly_connected_components

    if not g.edges.where("src = dst").isEmpty():
        return False
    parts = weakly_connected_components(g).select("component").distinct().count()
    return g.edge_count() == g.order() - parts


def is_cyclic(g: Graph) -> bool:
    return not is_acyclic(g)


def fold_walk(
    g: Graph, start: int, initial, folder: Callable[[object, int, WalkMetadata], tuple[str, object]], order: str = "bfs", max_edges: int = MAX_EDGES
):
    """Fold over a walk; ``folder`` returns (control, accumulator). A sequential kernel."""
    local = Local.of(g, max_edges)
    acc, seen = initial, set()
    todo: deque = deque([(start, 0, None)])
    if order == "bfs":
        seen.add(start)
    while todo:
        node, depth, parent = todo.popleft() if order == "bfs" else todo.pop()
        if order == "dfs":
            if node in seen:
                continue
            seen.add(node)
        control, acc = folder(acc, node, WalkMetadata(depth, parent))
        if control == HALT:
            break
        if control == STOP:
            continue
        near = list(local.out.get(node, ()))
        if order == "bfs":
            for v in near:
                if v not in seen:
                    seen.add(v)
                    todo.append((v, depth + 1, node))
        else:
            todo.extend((v, depth + 1, node) for v in reversed(near) if v not in seen)
    return acc


def walk(g: Graph, start: int, order: str = "bfs") -> list[int]:
    """The visiting order; ids ascending on ties."""
    return fold_walk(g, start, [], lambda acc, n, _: (acc.append(n) or CONTINUE, acc), order)


def walk_until(g: Graph, start: int, predicate: Callable[[int], bool], order: str = "bfs") -> list[int]:
    """The walk up to and with the first node for which ``predicate`` holds."""
    return fold_walk(g, start, [], lambda acc, n, _: (acc.append(n) or (HALT if predicate(n) else CONTINUE), acc), order)


def implicit_fold_by(start, successors: Callable[[object], Iterable], key: Callable, initial, folder, order: str = "bfs"):
    """Fold over a state space given by a successor function; states of one key count once."""
    acc, todo, seen = initial, deque([(start, 0, None)]), {key(start)} if order == "bfs" else set()
    while todo:
        state, depth, parent = todo.popleft() if order == "bfs" else todo.pop()
        if order == "dfs":
            if key(state) in seen:
                continue
            seen.add(key(state))
        control, acc = folder(acc, state, WalkMetadata(depth, parent))
        if control == HALT:
            break
        if control == STOP:
            continue
        near = list(successors(state))
        if order == "bfs":
            for s in near:
                if key(s) not in seen:
                    seen.add(key(s))
                    todo.append((s, depth + 1, state))
        else:
            todo.extend((s, depth + 1, state) for s in reversed(near))
    return acc


def implicit_fold(start, successors, initial, folder, order: str = "bfs"):
    return implicit_fold_by(start, successors, lambda s: s, initial, folder, order)


def implicit_dijkstra(start, successors: Callable[[object], Iterable[tuple[object, float]]], initial, folder):
    """Cheapest-first fold; ``successors`` gives (state, cost), ``folder(acc, state, cost)`` a control."""
    acc, best, heap, tick = initial, {start: 0}, [(0, 0, start)], 0
    while heap:
        cost, _, state = heapq.heappop(heap)
        if cost > best[state]:
            continue
        control, acc = folder(acc, state, cost)
        if control == HALT:
            break
        if control == STOP:
            continue
        for s, c in successors(state):
            if s not in best or cost + c < best[s]:
                best[s], tick = cost + c, tick + 1
                heapq.heappush(heap, (cost + c, tick, s))
    return acc


def topological_sort(g: Graph, max_edges: int = MAX_EDGES) -> list[int] | None:
    """First-in first-out order of nodes without predecessors left; None on a cycle."""
    return kernels.topological_order(Local.of(g, max_edges))


def lexicographical_topological_sort(g: Graph, key: Callable | None = None, max_edges: int = MAX_EDGES) -> list[int] | None:
    """As :func:`topological_sort`, the smallest payload (by ``key``) first."""
    local = Local.of(g, max_edges)
    return kernels.topological_order(local, lambda n: (key or (lambda d: d))(local.data.get(n)))


def best_first_fold(g: Graph, start: int, score: Callable[[int], float], initial, folder, max_edges: int = MAX_EDGES):
    """Fold over nodes by least score among those seen."""
    local, acc = Local.of(g, max_edges), initial
    seen, heap, tick = {start}, [(score(start), 0, start, WalkMetadata(0, None))], 0
    while heap:
        *_, node, meta = heapq.heappop(heap)
        control, acc = folder(acc, node, meta)
        if control == HALT:
            break
        if control == STOP:
            continue
        for v in local.out.get(node, ()):
            if v not in seen:
                seen.add(v)
                tick += 1
                heapq.heappush(heap, (score(v), tick, v, WalkMetadata(meta.depth + 1, node)))
    return acc


def best_first_walk(g: Graph, start: int, score: Callable[[int], float]) -> list[int]:
    return best_first_fold(g, start, score, [], lambda acc, n, _: (acc.append(n) or CONTINUE, acc))


def random_walk(g: Graph, start: int, steps: int, seed: int = 0, max_edges: int = MAX_EDGES) -> list[int]:
    """A uniform walk of up to ``steps`` steps; it ends at a sink."""
    local, r = Local.of(g, max_edges), random.Random(seed)
    path = [start]
    for _ in range(steps):
        near = list(local.out.get(path[-1], ()))
        if not near:
            break
        path.append(r.choice(near))
    return path


def random_walks(g: Graph, starts: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """(walk, step, id): one walk for each row of ``starts`` (id), as relational rounds.

    A step takes, of the next nodes, the one whose hash with walk, step and
    seed is least, so reruns give the same walks.
    """
    arcs = g.arcs().select("src", "dst")
    at = materialize(starts.select(F.col("id").alias("walk"), F.lit(0).alias("step"), "id"), "walks")
    out = at
    for i in range(1, steps + 1):
        draw = F.xxhash64("walk", F.lit(i), "dst", F.lit(seed))
        at = materialize(at.join(arcs, at["id"] == arcs["src"]).groupBy("walk").agg(F.min_by("dst", draw).alias("id")).select("walk", F.lit(i).alias("step"), "id"), "walks", n=F.count(F.lit(1)))
        if not stat(at, "n"):
            break
        out = out.unionByName(at)
    return out

