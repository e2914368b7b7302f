"""Planarity by path addition, tree decompositions and Weisfeiler-Lehman hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators import kernels
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.plans.materialize import materialize


def _blocks(near: dict) -> list[list[tuple]]:
    """Edge lists of the biconnected blocks, without recursion."""
    found, low, out, stack = {}, {}, [], []
    for root in sorted(near):
        if root in found:
            continue
        found[root] = low[root] = len(found)
        work = [(root, None, iter(sorted(near[root])))]
        while work:
            u, parent, rest = work[-1]
            for v in rest:
                if v not in found:
                    stack.append((u, v))
                    found[v] = low[v] = len(found)
                    work.append((v, u, iter(sorted(near[v]))))
                    break
                if v != parent and found[v] < found[u]:
                    stack.append((u, v))
                    low[u] = min(low[u], found[v])
            else:
                work.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if low[u] >= found[parent]:
                        block = []
                        while True:
                            e = stack.pop()
                            block.append(e)
                            if e == (parent, u):
                                break
                        out.append(block)
    return out


def _cycle(near: dict) -> list:
    """Some cycle of a biconnected graph of at least three nodes."""
    root = min(near)
    parent, stack = {root: None}, [root]
    depth = {root: 0}
    while stack:
        u = stack.pop()
        for v in sorted(near[u]):
            if v == parent[u]:
                continue
            if v in parent:
                a, b, left, right = u, v, [u], [v]
                while a != b:
                    if depth[a] >= depth[b]:
                        a = parent[a]
                        left.append(a)
                    else:
                        b = parent[b]
                        right.append(b)
                return left + right[-2::-1]
            parent[v], depth[v] = u, depth[u] + 1
            stack.append(v)
    raise ValueError("no cycle")


def _faces(edges: list[tuple]) -> list[list] | None:
    """Oriented faces of a planar block (every directed edge in one face), or None."""
    near: dict = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    n, m = len(near), len(edges)
    if m == 1:
        return [list(edges[0])]
    if m > 3 * n - 6 and n >= 3:
        return None
    ring = _cycle(near)
    faces = [ring, ring[::-1]]
    placed = set(ring)
    done = {frozenset(e) for e in zip(ring, ring[1:] + ring[:1], strict=True)}
    while len(done) < m:
        # pieces of the rest: single edges between placed nodes, or components with their attachments
        pieces, seen = [], set()
        for u in sorted(placed):
            for v in sorted(near[u]):
                if v in placed:
                    if u < v and frozenset((u, v)) not in done:
                        pieces.append(({u, v}, set()))
                elif v not in seen:
                    inner, touch, todo = {v}, set(), [v]
                    while todo:
                        for y in near[todo.pop()]:
                            if y in placed:
                                touch.add(y)
                            elif y not in inner:
                                inner.add(y)
                                todo.append(y)
                    seen |= inner
                    pieces.append((touch, inner))
        best = None
        sets = [set(f) for f in faces]
        for touch, inner in pieces:
            fits = [i for i, f in enumerate(sets) if touch <= f]
            if not fits:
                return None
            if best is None or len(fits) < best[0]:
                best = (len(fits), fits[0], touch, inner)
                if len(fits) == 1:
                    break
        _, i, touch, inner = best
        a = min(touch)
        if not inner:
            path = [a, max(touch)]
        else:
            parent, todo, end = {a: None}, [a], None
            while end is None:
                nxt = []
                for u in todo:
                    for v in sorted(near[u]):
                        if v in parent or (u == a and v not in inner):
                            continue
                        if v in inner:
                            parent[v] = u
                            nxt.append(v)
                        elif v in touch and u != a:
                            parent[v], end = u, v
                            break
                    if end is not None:
                        break
                todo = nxt
            path = kernels.trace(parent, end)
        b = path[-1]
        face = faces.pop(i)
        x = face.index(a)
        face = face[x:] + face[:x]
        y = face.index(b)
        faces.append(face[: y + 1] + path[-2:0:-1])
        faces.append(face[y:] + path[:-1])
        placed |= set(path)
        done |= {frozenset(e) for e in zip(path, path[1:], strict=False)}
    return faces


def _embed(local: Local) -> dict | None:
    """Clockwise neighbours of each node, or None if not planar."""
    near = {n: set(local.near(n)) - {n} for n in local.nodes}
    rotation: dict = {n: [] for n in local.nodes}
    for block in _blocks(near):
        faces = _faces(block)
        if faces is None:
            return None
        turn: dict = {}
        for f in faces:
            for u, v, w in zip(f, f[1:] + f[:1], f[2:] + f[:2], strict=True) if len(f) > 2 else [(f[0], f[1], f[0]), (f[1], f[0], f[1])]:
                turn.setdefault(v, {})[u] = w
        for v, after in turn.items():
            first = min(after)
            u = first
            while True:
                rotation[v].append(u)
                u = after[u]
                if u == first:
                    break
    return rotation


@dataclass(frozen=True)
class KuratowskiWitness:
    kind: str  # K5, K33 or unknown
    nodes: list[int]
    edges: list[tuple[int, int]]


def is_planar(g: Graph, max_edges: int = MAX_EDGES) -> bool:
    """Whether an undirected graph can be drawn without crossings; directed: false."""
    return not g.directed and _embed(Local.of(g, max_edges)) is not None


def _witness(local: Local) -> KuratowskiWitness | None:
    edges = [e for e in local.edges() if e[0] != e[1]]
    if _embed(Local(local.nodes, edges, False)) is not None:
        return None
    i = 0
    step = max(1, len(edges) // 2)
    while step:
        i = 0
        while i < len(edges):
            fewer = edges[:i] + edges[i + step :]
            if _embed(Local([], fewer, False)) is None:
                edges = fewer
            else:
                i += step
        step //= 2
    degree: dict = {}
    for u, v, _ in edges:
        degree[u] = degree.get(u, 0) + 1
        degree[v] = degree.get(v, 0) + 1
    corners = sorted(n for n, d in degree.items() if d > 2)
    kinds = sorted(degree[n] for n in corners)
    kind = "K5" if kinds == [4] * 5 else "K33" if kinds == [3] * 6 else "unknown"
    return KuratowskiWitness(kind, sorted(degree), sorted((u, v) for u, v, _ in edges))


def kuratowski_witness(g: Graph, max_edges: int = MAX_EDGES) -> KuratowskiWitness | None:
    """A smallest-by-edges non-planar part (subdivided K5 or K3,3), or None if planar."""
    return None if g.directed else _witness(Local.of(g, max_edges))


def planar_embedding(g: Graph, max_edges: int = MAX_EDGES) -> tuple[dict[int, list[int]] | None, KuratowskiWitness | None]:
    """(clockwise neighbours, None), or (None, witness)."""
    local = Local.of(g, max_edges)
    found = None if g.directed else _embed(local)
    return (found, None) if found is not None else (None, _witness(local))


@dataclass(frozen=True)
class TreeDecomposition:
    bags: dict[int, set[int]]
    tree: list[tuple[int, int]]
    width: int


def tree_decomposition(g: Graph, heuristic: str = "min_degree", max_edges: int = MAX_EDGES) -> TreeDecomposition:
    """Bags by an elimination order (min_degree or min_fill)."""
    width, bags, parent = kernels.eliminate(Local.of(g, max_edges), heuristic)
    return TreeDecomposition(dict(enumerate(bags)), [(i, p) for i, p in enumerate(parent) if p is not None], width)


def treewidth_upper_bound(g: Graph, heuristic: str = "min_degree", max_edges: int = MAX_EDGES) -> int:
    return tree_decomposition(g, heuristic, max_edges).width


def is_valid_decomposition(g: Graph, d: TreeDecomposition, max_edges: int = MAX_EDGES) -> bool:
    return kernels.valid_decomposition(Local.of(g, max_edges), d.bags, d.tree)


def graph_hash(g: Graph, rounds: int = 3, label=None) -> str:
    """md5 of the sorted labels after ``rounds`` of relabelling by sorted neighbours' labels."""
    arcs = materialize(g.arcs().select("src", "dst"), "arcs")
    label = F.col("degree").cast("string") if label is None else label
    state = materialize(g.nodes.join(g.degrees(), "id").select("id", label.alias("label")), "labels")
    for _ in range(rounds):
        near = arcs.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("near"))
        new = F.md5(F.concat_ws("|", "label", F.coalesce("near", F.lit(""))))
        state = materialize(state.join(near, "id", "left").select("id", new.alias("label")), "labels")
    counts = state.groupBy("label").agg(F.count("*").alias("n"))
    row = counts.agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda x: F.concat_ws("*", x["label"], x["n"].cast("string"))), ",")).alias("h")).first()
    return row["h"]


def default_graph_hash(g: Graph) -> str:
    return graph_hash(g, 3)


def wl_labels(g: Graph, rounds: int = 3) -> DataFrame:
    """(id, label): stable numbers of nodes after ``rounds`` of relabelling, as digests."""
    arcs = materialize(g.arcs().select("src", "dst"), "arcs")
    state = g.degrees().select("id", F.col("degree").cast("string").alias("label"))
    for _ in range(rounds):
        near = arcs.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("near"))
        state = materialize(state.join(near, "id", "left").select("id", F.md5(F.concat_ws("|", "label", F.coalesce("near", F.lit("")))).alias("label")), "labels")
    return state
