"""Sequential graph algorithms on :class:`~arcweave.operators.local.Local` graphs.

Plain functions without Spark; they run on the driver behind a size guard or
in one task per component.  Ties go to the smaller id throughout.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from itertools import combinations


# ---------------------------------------------------------------- orders


def topological_order(g, key=None) -> list[int] | None:
    """First-in first-out removal order (by ``key`` then id if given); None on a cycle."""
    need = {n: len(g.into[n]) for n in g.nodes}
    first = [n for n in g.nodes if not need[n]]
    out = []
    if key is None:
        todo = deque(first)
        while todo:
            n = todo.popleft()
            out.append(n)
            for v in g.out[n]:
                need[v] -= 1
                if not need[v]:
                    todo.append(v)
    else:
        heap = [(key(n), n) for n in first]
        heapq.heapify(heap)
        while heap:
            _, n = heapq.heappop(heap)
            out.append(n)
            for v in g.out[n]:
                need[v] -= 1
                if not need[v]:
                    heapq.heappush(heap, (key(v), v))
    return out if len(out) == len(g.nodes) else None


# ---------------------------------------------------------------- paths


def dijkstra(out, start, goal=None, zero=0, extend=lambda d, w: d + w, rank=lambda d: d, heuristic=None):
    """(distance, parent) maps from ``start``; ``rank`` orders distances, a heuristic makes it A*."""
    dist, parent, done = {start: zero}, {start: None}, set()
    first = rank(zero) if heuristic is None else rank(zero) + heuristic(start)
    heap = [(first, start)]
    while heap:
        r, u = heapq.heappop(heap)
        if heuristic is None and u in done:
            continue
        done.add(u)
        if u == goal:
            break
        for v, w in out.get(u, {}).items():
            d = extend(dist[u], w)
            if v not in dist or rank(d) < rank(dist[v]):
                dist[v], parent[v] = d, u
                heapq.heappush(heap, (rank(d) if heuristic is None else rank(d) + heuristic(v), v))
    return dist, parent


def trace(parent, goal) -> list[int]:
    path = []
    while goal is not None:
        path.append(goal)
        goal = parent[goal]
    return path[::-1]


def shortest_path(out, start, goal, **how):
    """(nodes, weight), or None."""
    dist, parent = dijkstra(out, start, goal, **how)
    return (trace(parent, goal), dist[goal]) if goal in dist else None


def bidirectional(g, start, goal, unweighted=False):
    """(nodes, weight) met from both ends, or None."""
    if start == goal:
        return [start], 0
    sides = [(g.out, {start: 0}, {start: None}, [(0, start)], set()), (g.into, {goal: 0}, {goal: None}, [(0, goal)], set())]
    best, meet = None, None
    while sides[0][3] and sides[1][3]:
        if best is not None and sides[0][3][0][0] + sides[1][3][0][0] >= best:
            break
        side = 0 if sides[0][3][0][0] <= sides[1][3][0][0] else 1
        adj, dist, parent, heap, done = sides[side]
        other = sides[1 - side][1]
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u in other and (best is None or d + other[u] < best):
            best, meet = d + other[u], u
        for v, w in adj.get(u, {}).items():
            nd = d + (1 if unweighted else w)
            if v not in dist or nd < dist[v]:
                dist[v], parent[v] = nd, u
                heapq.heappush(heap, (nd, v))
                if v in other and (best is None or nd + other[v] < best):
                    best, meet = nd + other[v], v
    if meet is None:
        return None
    back = trace(sides[1][2], meet)[::-1]
    return trace(sides[0][2], meet) + back[1:], best


def k_shortest_paths(g, start, goal, k):
    """Up to ``k`` loopless paths by weight, ties by node list: deviations from each found path."""
    if k < 1:
        return None
    first = shortest_path(g.out, start, goal)
    if first is None:
        return None
    found, waiting, known = [first], [], {tuple(first[0])}
    while len(found) < k:
        nodes = found[-1][0]
        cost = 0
        for i in range(len(nodes) - 1):
            root = nodes[: i + 1]
            banned = {p[i + 1] for p, _ in found if len(p) > i + 1 and p[: i + 1] == root}
            cut = set(root[:-1])
            out = {
                u: {v: w for v, w in near.items() if v not in cut and not (u == root[-1] and v in banned)}
                for u, near in g.out.items() if u not in cut
            }
            spur = shortest_path(out, root[-1], goal)
            if spur is not None:
                path = root[:-1] + spur[0]
                if tuple(path) not in known:
                    known.add(tuple(path))
                    heapq.heappush(waiting, (cost + spur[1], path))
            cost = cost + g.out[nodes[i]][nodes[i + 1]]
        if not waiting:
            break
        w, p = heapq.heappop(waiting)
        found.append((p, w))
    return found


def bellman_ford(nodes, edges, start):
    """(distance, parent, cycle): ``cycle`` tells of a negative one reachable from ``start``."""
    dist, parent = {start: 0}, {start: None}
    for i in range(len(nodes)):
        changed = False
        for u, v, w in edges:
            if u in dist and (v not in dist or dist[u] + w < dist[v]):
                dist[v], parent[v], changed = dist[u] + w, u, True
        if not changed:
            return dist, parent, False
    return dist, parent, any(u in dist and dist[u] + w < dist[v] for u, v, w in edges)


# ---------------------------------------------------------------- connectivity


def bridges_and_cuts(g):
    """(bridges as (u < v), articulation points) of an undirected graph, without recursion."""
    found, low, bridges, cuts = {}, {}, [], set()
    for root in g.nodes:
        if root in found:
            continue
        found[root] = low[root] = len(found)
        stack = [(root, None, iter(g.out[root]))]
        children = 0
        while stack:
            u, parent, rest = stack[-1]
            for v in rest:
                if v == u:
                    continue
                if v not in found:
                    found[v] = low[v] = len(found)
                    stack.append((v, u, iter(g.out[v])))
                    children += u == root
                    break
                if v != parent:
                    low[u] = min(low[u], found[v])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[u])
                    if low[u] > found[parent]:
                        bridges.append((min(u, parent), max(u, parent)))
                    if parent != root and low[u] >= found[parent]:
                        cuts.add(parent)
        if children > 1:
            cuts.add(root)
    return sorted(bridges), sorted(cuts)


def strong_components(g) -> list[list[int]]:
    """Strongly connected components in reverse topological order, without recursion."""
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in g.nodes:
        if root in index:
            continue
        work = [(root, iter(g.out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            u, rest = work[-1]
            for v in rest:
                if v not in index:
                    index[v] = low[v] = len(index)
                    stack.append(v)
                    on.add(v)
                    work.append((v, iter(g.out[v])))
                    break
                if v in on:
                    low[u] = min(low[u], index[v])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == index[u]:
                    part = []
                    while True:
                        v = stack.pop()
                        on.discard(v)
                        part.append(v)
                        if v == u:
                            break
                    out.append(sorted(part))
    return out


# ---------------------------------------------------------------- trees


class Sets:
    """Disjoint sets with path halving and union by size."""

    def __init__(self):
        self.parent, self.size = {}, {}

    def find(self, x):
        if x not in self.parent:
            self.parent[x], self.size[x] = x, 1
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.parent[y] = x
        self.size[x] += self.size[y]
        return True


def kruskal(g) -> list[tuple]:
    sets = Sets()
    return [(u, v, w) for w, u, v in sorted((w, u, v) for u, v, w in g.edges() if u != v) if sets.union(u, v)]


def prim(g, start=None) -> list[tuple]:
    """The spanning tree of the smallest node's component."""
    if not g.nodes:
        return []
    start = g.nodes[0] if start is None else start
    seen, out = {start}, []
    heap = [(w, start, v) for v, w in g.out[start].items()]
    heapq.heapify(heap)
    while heap:
        w, u, v = heapq.heappop(heap)
        if v in seen:
            continue
        seen.add(v)
        out.append((min(u, v), max(u, v), w))
        for x, wx in g.out[v].items():
            if x not in seen:
                heapq.heappush(heap, (wx, v, x))
    return out


def arborescence(nodes, edges, root) -> list[tuple] | None:
    """Least-weight tree of directed edges from ``root`` to all nodes; None where there is none."""
    edges = [(u, v, w, i) for i, (u, v, w) in enumerate(edges) if u != v and v != root]
    alive = set(nodes)

    def solve(alive, edges, root):
        best = {}
        for e in edges:
            if e[1] not in best or (e[2], e[3]) < (best[e[1]][2], best[e[1]][3]):
                best[e[1]] = e
        if any(n not in best for n in alive if n != root):
            return None
        state, cycle = {root: 2}, None
        for n in sorted(alive, key=repr):
            path, u = [], n
            while u not in state:
                state[u] = 1
                path.append(u)
                u = best[u][0]
            if state[u] == 1:
                cycle = path[path.index(u) :]
                break
            for x in path:
                state[x] = 2
        if cycle is None:
            return {best[n][3] for n in alive if n != root}
        inside, new = set(cycle), ("cycle", cycle[0], len(alive))
        moved, into = [], {}
        for u, v, w, i in edges:
            if u in inside and v in inside:
                continue
            if v in inside:
                into[i] = v
                moved.append((u, new, w - best[v][2], i))
            elif u in inside:
                moved.append((new, v, w, i))
            else:
                moved.append((u, v, w, i))
        picked = solve((alive - inside) | {new}, moved, root)
        if picked is None:
            return None
        enters = next(into[i] for i in picked if i in into)
        return picked | {best[v][3] for v in cycle if v != enters}

    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10 * len(alive) + 1000))
    try:
        ids = solve(alive, edges, root)
    finally:
        sys.setrecursionlimit(limit)
    if ids is None:
        return None
    return sorted((u, v, w) for u, v, w, i in edges if i in ids)


def random_spanning_tree(g, rng) -> list[tuple] | None:
    """A uniform spanning tree by loop-erased walks; None if some node can't be reached."""
    if not g.nodes:
        return []
    inside, out = {g.nodes[0]}, []
    reach = set(next(c for c in g.components() if g.nodes[0] in c))
    if len(reach) < len(g.nodes):
        return None
    for n in g.nodes:
        nxt, u = {}, n
        while u not in inside:
            nxt[u] = rng.choice(g.near(u))
            u = nxt[u]
        u = n
        while u not in inside:
            v = nxt[u]
            out.append((min(u, v), max(u, v), g.out[u].get(v, g.into[u].get(v))))
            inside.add(u)
            u = v
    return sorted(out)


# ---------------------------------------------------------------- flows and cuts


class Residual:
    """Residual capacities; ``cap[u][v]`` and its reverse always both exist."""

    def __init__(self, g):
        self.cap = {n: {} for n in g.nodes}
        for u in g.nodes:
            for v, w in g.out[u].items():
                self.cap[u][v] = self.cap[u].get(v, 0) + w
                self.cap[v].setdefault(u, 0)

    def push(self, u, v, f):
        self.cap[u][v] -= f
        self.cap[v][u] += f

    def reach(self, s) -> set:
        seen, todo = {s}, [s]
        while todo:
            u = todo.pop()
            for v, c in self.cap.get(u, {}).items():
                if c > 0 and v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen


def edmonds_karp(g, s, t):
    r, total = Residual(g), 0
    while s != t and s in r.cap:
        parent, todo = {s: None}, deque([s])
        while todo and t not in parent:
            u = todo.popleft()
            for v, c in r.cap[u].items():
                if c > 0 and v not in parent:
                    parent[v] = u
                    todo.append(v)
        if t not in parent:
            break
        path = trace(parent, t)
        f = min(r.cap[u][v] for u, v in zip(path, path[1:], strict=False))
        for u, v in zip(path, path[1:], strict=False):
            r.push(u, v, f)
        total += f
    return total, r


def dinic(g, s, t):
    r, total = Residual(g), 0
    while s != t and s in r.cap:
        level, todo = {s: 0}, deque([s])
        while todo:
            u = todo.popleft()
            for v, c in r.cap[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        if t not in level:
            break
        rest = {u: iter(list(r.cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                f = min(r.cap[a][b] for a, b in zip(path, path[1:], strict=False))
                total += f
                cut = None
                for i, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    r.push(a, b, f)
                    if r.cap[a][b] == 0 and cut is None:
                        cut = i
                # the saturated arc's iterator has moved past it; walk on from its tail
                path = path[: cut + 1]
                continue
            for v in rest[u]:
                if r.cap[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
    return total, r


def push_relabel(g, s, t):
    r = Residual(g)
    if s == t or s not in r.cap or t not in r.cap:
        return 0, r
    n = len(r.cap)
    height, excess = dict.fromkeys(r.cap, 0), dict.fromkeys(r.cap, 0)
    height[s] = n
    todo = deque()
    for v, c in list(r.cap[s].items()):
        if c > 0 and v != s:
            r.push(s, v, c)
            excess[v] += c
            if v != t:
                todo.append(v)
    while todo:
        u = todo.popleft()
        while excess[u] > 0:
            low = None
            for v, c in r.cap[u].items():
                if c > 0 and v != u:
                    if height[u] == height[v] + 1:
                        f = min(c, excess[u])
                        r.push(u, v, f)
                        excess[u] -= f
                        if excess[v] == 0 and v not in (s, t):
                            todo.append(v)
                        excess[v] += f
                        if excess[u] == 0:
                            break
                    elif low is None or height[v] < low:
                        low = height[v]
            if excess[u] > 0:
                low = min((height[v] for v, c in r.cap[u].items() if c > 0 and v != u), default=None)
                if low is None:
                    break
                height[u] = low + 1
    return excess[t], r


def global_min_cut(g, held: dict | None = None):
    """(weight, size, size) of the least cut of an undirected graph, by maximum adjacency orders; ``held`` has how many nodes each stands for."""
    if len(g.nodes) <= 1:
        return None, 0, 0
    adj = {u: {v: w for v, w in g.out[u].items() if v != u} for u in g.nodes}
    size = dict(held or dict.fromkeys(g.nodes, 1))
    total, best = sum(size.values()), None
    while len(adj) > 1:
        start = min(adj)
        key, added, heap, order = dict.fromkeys(adj, 0), set(), [(0, start)], []
        waiting = [(0, u) for u in sorted(adj) if u != start]
        heap += waiting
        heapq.heapify(heap)
        first = True
        while len(order) < len(adj):
            k, u = heapq.heappop(heap)
            if first:
                u, first = start, False
            elif u in added or -k != key[u]:
                continue
            if u in added:
                continue
            added.add(u)
            order.append(u)
            for v, w in adj[u].items():
                if v not in added:
                    key[v] += w
                    heapq.heappush(heap, (-key[v], v))
        t, s = order[-1], order[-2]
        if best is None or key[t] < best[0]:
            best = (key[t], size[t], total - size[t])
        for v, w in adj.pop(t).items():
            del adj[v][t]
            if v != s:
                adj[s][v] = adj[s].get(v, 0) + w
                adj[v][s] = adj[s][v]
        size[s] += size.pop(t)
    return best


# ---------------------------------------------------------------- matchings


def two_sides(g) -> dict | None:
    """0 or 1 for each node, the smallest node of a component being 0; None on an odd cycle."""
    side = {}
    for root in g.nodes:
        if root in side:
            continue
        side[root], todo = 0, deque([root])
        while todo:
            u = todo.popleft()
            for v in g.near(u):
                if v not in side:
                    side[v] = 1 - side[u]
                    todo.append(v)
                elif side[v] == side[u]:
                    return None
    return side


def hopcroft_karp(g, side) -> dict:
    """A largest matching of a bipartite graph, as a symmetric map."""
    left = [n for n in g.nodes if side[n] == 0]
    mate = {}
    while True:
        level = {u: 0 for u in left if u not in mate}
        todo, found = deque(level), False
        while todo:
            u = todo.popleft()
            for v in g.near(u):
                w = mate.get(v)
                if w is None:
                    found = True
                elif w not in level:
                    level[w] = level[u] + 1
                    todo.append(w)
        if not found:
            return mate
        for root in [u for u in left if u not in mate]:
            stack = [(root, iter(g.near(root)))]
            chosen = []
            while stack:
                u, rest = stack[-1]
                for v in rest:
                    w = mate.get(v)
                    if w is None:
                        chosen.append((u, v))
                        for a, b in chosen:
                            mate[a], mate[b] = b, a
                        stack = []
                        break
                    if level.get(w) == level[u] + 1:
                        chosen.append((u, v))
                        stack.append((w, iter(g.near(w))))
                        break
                else:
                    level[u] = -1
                    stack.pop()
                    if chosen:
                        chosen.pop()


def hungarian(cost: list[list[float]]) -> tuple[float, list[int]]:
    """Least-cost assignment of a square matrix: (cost, column of each row), by potentials."""
    n = len(cost)
    inf = float("inf")
    u, v, match = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [inf] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    columns = [0] * n
    for j in range(1, n + 1):
        columns[match[j] - 1] = j - 1
    return sum(cost[i][columns[i]] for i in range(n)), columns


def general_matching(g) -> dict:
    """A largest matching of any undirected graph, by contracting blossoms."""
    mate = {}
    near = {n: [v for v in g.near(n) if v != n] for n in g.nodes}
    for u in g.nodes:  # a greedy start
        if u not in mate:
            for v in near[u]:
                if v not in mate:
                    mate[u], mate[v] = v, u
                    break

    def augment(root) -> bool:
        base = {n: n for n in g.nodes}
        parent, even = {}, {root}
        todo = deque([root])

        def common(a, b):
            seen = set()
            while True:
                a = base[a]
                seen.add(a)
                if a not in mate or a == base[root]:
                    break
                a = parent[mate[a]]
            while True:
                b = base[b]
                if b in seen:
                    return b
                b = parent[mate[b]]

        def mark(v, b, child, blossom):
            while base[v] != b:
                blossom.add(base[v])
                blossom.add(base[mate[v]])
                parent[v] = child
                child = mate[v]
                v = parent[mate[v]]

        while todo:
            u = todo.popleft()
            for v in near[u]:
                if base[u] == base[v] or mate.get(u) == v:
                    continue
                if v == root or (v in mate and mate[v] in parent):
                    b, blossom = common(u, v), set()
                    mark(u, b, v, blossom)
                    mark(v, b, u, blossom)
                    for n in g.nodes:
                        if base[n] in blossom:
                            base[n] = b
                            if n not in even:
                                even.add(n)
                                todo.append(n)
                elif v not in parent:
                    parent[v] = u
                    if v not in mate:
                        while v is not None:
                            p = parent[v]
                            nxt = mate.get(p)
                            mate[v], mate[p] = p, v
                            v = nxt
                        return True
                    even.add(mate[v])
                    todo.append(mate[v])
        return False

    for n in g.nodes:
        if n not in mate and near[n]:
            augment(n)
    return mate


def stable_marriage(left: dict, right: dict) -> dict:
    """Left proposes in order of preference; left to right. KeyError if a receiver lacks a ranking."""
    rank = {r: {p: i for i, p in enumerate(prefs)} for r, prefs in right.items()}
    at, holder, free = dict.fromkeys(left, 0), {}, deque(sorted(left))
    while free:
        p = free.popleft()
        if at[p] >= len(left[p]):
            continue
        r = left[p][at[p]]
        at[p] += 1
        held = holder.get(r)
        if held is None:
            rank[r][p]  # noqa: B018  a ranking is needed
            holder[r] = p
        elif rank[r][p] < rank[r][held]:
            holder[r] = p
            free.append(held)
        else:
            free.append(p)
    return {p: r for r, p in holder.items()}


# ---------------------------------------------------------------- cliques and colours


def maximal_cliques(g):
    """All maximal cliques, pivoting; an empty graph has the empty clique."""
    near = {n: set(g.near(n)) - {n} for n in g.nodes}
    stack = [((), set(g.nodes), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            yield tuple(sorted(r))
            continue
        pivot = max(p | x, key=lambda n: (len(near[n] & p), -n))
        for v in sorted(p - near[pivot]):
            stack.append(((*r, v), p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}


def max_clique(g) -> tuple:
    return max(maximal_cliques(g), key=lambda c: (len(c), [-n for n in c]))


def k_cliques(g, k):
    if k <= 0:
        return
    later = {n: {v for v in g.near(n) if v > n} for n in g.nodes}

    def grow(clique, allowed):
        if len(clique) == k:
            yield clique
            return
        for v in sorted(allowed):
            yield from grow((*clique, v), allowed & later[v])

    for n in g.nodes:
        yield from grow((n,), later[n])


def greedy_colors(g, order=None) -> dict:
    """Colours from 1, nodes by falling degree then id."""
    near = {n: set(g.near(n)) - {n} for n in g.nodes}
    color = {}
    for n in order or sorted(g.nodes, key=lambda n: (-len(near[n]), n)):
        used = {color[v] for v in near[n] if v in color}
        color[n] = next(c for c in range(1, len(used) + 2) if c not in used)
    return color


def dsatur(g) -> dict:
    """Colours from 1, always the node with most coloured kinds around it, then degree, then id."""
    near = {n: set(g.near(n)) - {n} for n in g.nodes}
    color, around = {}, {n: set() for n in g.nodes}
    heap = [(0, -len(near[n]), n) for n in g.nodes]
    heapq.heapify(heap)
    while heap:
        s, _, n = heapq.heappop(heap)
        if n in color or -s != len(around[n]):
            continue
        color[n] = next(c for c in range(1, len(around[n]) + 2) if c not in around[n])
        for v in near[n]:
            if v not in color and color[n] not in around[v]:
                around[v].add(color[n])
                heapq.heappush(heap, (-len(around[v]), -len(near[v]), v))
    return color


def exact_colors(g, timeout: float = 5.0) -> tuple[dict, bool]:
    """(colours, proved): branch and bound below the greedy bound; unproved after ``timeout`` seconds."""
    near = {n: set(g.near(n)) - {n} for n in g.nodes}
    best = dsatur(g)
    if not best:
        return best, True
    lower = len(max_clique(g)) if len(g.nodes) <= 200 else 2
    end = time.monotonic() + timeout
    order = sorted(g.nodes, key=lambda n: (-len(near[n]), n))

    def search(limit) -> dict | None | bool:
        """Colours with fewer than ``limit`` kinds, None if there are none, False out of time."""
        color: dict = {}
        tried = [0] * (len(order) + 1)
        i = 0
        picked: list = []
        while True:
            if time.monotonic() > end:
                return False
            if i == len(order):
                return dict(color)
            if len(picked) <= i:
                free = [n for n in order if n not in color]
                n = max(free, key=lambda n: (len({color[v] for v in near[n] if v in color}), len(near[n]), -n))
                picked.append(n)
                tried[i] = 0
            n = picked[i]
            used = {color[v] for v in near[n] if v in color}
            top = min(limit - 1, max(color.values(), default=0) + 1)
            c = next((c for c in range(tried[i] + 1, top + 1) if c not in used), None)
            if c is None:
                picked.pop()
                i -= 1
                if i < 0:
                    return None
                tried[i] = color.pop(picked[i])
            else:
                color[n] = c
                tried[i] = c
                i += 1

    while max(best.values()) > lower:
        found = search(max(best.values()))
        if found is False:
            return best, False
        if found is None:
            break
        best = found
    return best, True


# ---------------------------------------------------------------- tours


def euler_trail(arcs: dict, start, directed: bool):
    """Edge and node list of a trail over all edges: ``arcs[u]`` = [(v, edge id)]."""
    rest = {u: list(reversed(sorted(x, key=lambda t: t[1]))) for u, x in arcs.items()}
    used, stack, out = set(), [(start, None)], []
    while stack:
        u, _ = stack[-1]
        while rest.get(u) and rest[u][-1][1] in used:
            rest[u].pop()
        if rest.get(u):
            v, e = rest[u].pop()
            used.add(e)
            stack.append((v, e))
        else:
            out.append(stack.pop())
    out.reverse()
    return [n for n, _ in out], [e for _, e in out[1:]]


def euler_ends(arcs: dict, directed: bool):
    """(circuit?, path?, start) from degrees; arcs as for :func:`euler_trail`."""
    out = {u: len(x) for u, x in arcs.items()}
    if directed:
        into: dict = dict.fromkeys(arcs, 0)
        for x in arcs.values():
            for v, _ in x:
                into[v] = into.get(v, 0) + 1
        nodes = sorted({*out, *into})
        more = [n for n in nodes if out.get(n, 0) - into.get(n, 0) == 1]
        less = [n for n in nodes if into.get(n, 0) - out.get(n, 0) == 1]
        odd = [n for n in nodes if abs(out.get(n, 0) - into.get(n, 0)) > 1]
        circuit = not (more or less or odd)
        path = circuit or (len(more) == len(less) == 1 and not odd)
        start = more[0] if more else next((n for n in nodes if out.get(n, 0)), None)
    else:
        odd = sorted(n for n, d in out.items() if d % 2)
        circuit, path = not odd, len(odd) in (0, 2)
        start = odd[0] if odd else next((n for n in sorted(out) if out[n]), None)
    touched = {n for n, x in arcs.items() if x} | {v for x in arcs.values() for v, _ in x}
    if not touched:
        return False, False, None
    around: dict = {n: set() for n in touched}
    for u, x in arcs.items():
        for v, _ in x:
            around[u].add(v)
            around[v].add(u)
    seen, todo = set(), [next(iter(touched))]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo.extend(around[n] - seen)
    joined = seen == touched
    return circuit and joined, path and joined, start


def chinese_postman(g):
    """(closed walk, weight) over all edges of a connected undirected graph, or None.

    Odd nodes are paired at least cost by general search over pairs (bit masks).
    """
    edges = g.edges()
    if g.directed or not edges:
        return None
    touched = sorted({n for u, v, _ in edges for n in (u, v)})
    if len([c for c in g.components() if len(c) > 1 or g.out[c[0]]]) != 1:
        return None
    degree = {n: sum(2 if v == n else 1 for v in g.out[n]) for n in touched}
    odd = [n for n in touched if degree[n] % 2]
    if len(odd) > 22:
        raise ValueError("more than 22 odd nodes; pairing them exactly would take too long")
    ways = {n: dijkstra(g.out, n) for n in odd}
    best: dict[int, tuple] = {0: (0, None)}
    whole = (1 << len(odd)) - 1
    for mask in range(1, whole + 1):
        if bin(mask).count("1") % 2:
            continue
        i = mask.bit_length() - 1
        options = []
        for j in range(i):
            if mask >> j & 1:
                rest = mask & ~(1 << i) & ~(1 << j)
                options.append((best[rest][0] + ways[odd[i]][0][odd[j]], (i, j)))
        best[mask] = min(options)
    arcs: dict = {n: [] for n in touched}
    count = 0

    def add(u, v):
        nonlocal count
        arcs[u].append((v, count))
        if u != v:
            arcs[v].append((u, count))
        count += 1

    for u, v, _ in edges:
        add(u, v)
    mask = whole
    while mask:
        i, j = best[mask][1]
        path = trace(ways[odd[i]][1], odd[j])
        for u, v in zip(path, path[1:], strict=False):
            add(u, v)
        mask &= ~(1 << i) & ~(1 << j)
    nodes, _ = euler_trail(arcs, touched[0], False)
    return nodes, sum(w for *_, w in edges) + best[whole][0]


# ---------------------------------------------------------------- shape


def is_chordal(g) -> bool:
    """Whether a maximum cardinality order is a perfect elimination order."""
    near = {n: set(g.near(n)) - {n} for n in g.nodes}
    weight, order = dict.fromkeys(g.nodes, 0), []
    heap = [(0, n) for n in g.nodes]
    while heap:
        w, n = heapq.heappop(heap)
        if n not in weight or -w != weight[n]:
            continue
        del weight[n]
        order.append(n)
        for v in near[n]:
            if v in weight:
                weight[v] += 1
                heapq.heappush(heap, (-weight[v], v))
    at = {n: i for i, n in enumerate(order)}
    for n in order:
        earlier = [v for v in near[n] if at[v] < at[n]]
        if earlier:
            last = max(earlier, key=at.__getitem__)
            if not (set(earlier) - {last}) <= near[last]:
                return False
    return True


def isomorphic(a, b) -> bool:
    """Backtracking over nodes in an order that keeps the mapped part connected, pruned by degrees."""
    if a.directed != b.directed or len(a.nodes) != len(b.nodes) or a.size() != b.size():
        return False
    sign = lambda g, n: (len(g.out[n]), len(g.into[n]), n in g.out[n], tuple(sorted((len(g.out[v]), len(g.into[v])) for v in g.near(n))))
    of_b: dict = {}
    for n in b.nodes:
        of_b.setdefault(sign(b, n), []).append(n)
    of_a = {n: sign(a, n) for n in a.nodes}
    if sorted(of_a.values()) != sorted(s for s, x in of_b.items() for _ in x):
        return False
    order, seen = [], set()
    for root in sorted(a.nodes, key=lambda n: (len(of_b[of_a[n]]), -len(a.out[n]), n)):
        todo = [root]
        while todo:
            n = todo.pop(0)
            if n not in seen:
                seen.add(n)
                order.append(n)
                todo.extend(v for v in a.near(n) if v not in seen)
    mapped, used = {}, set()
    choices = [iter(of_b[of_a[order[0]]])] if order else []
    while choices:
        i = len(choices) - 1
        n = order[i]
        if n in mapped:
            used.discard(mapped.pop(n))
        for m in choices[-1]:
            if m in used:
                continue
            if all((mapped[v] in b.out[m]) for v in a.out[n] if v in mapped) and all((mapped[v] in b.into[m]) for v in a.into[n] if v in mapped):
                mapped[n] = m
                used.add(m)
                break
        else:
            choices.pop()
            continue
        if i + 1 == len(order):
            return True
        choices.append(iter(of_b[of_a[order[i + 1]]]))
    return not order


def eliminate(g, heuristic: str = "min_degree"):
    """(width, bags, parent bag): bags by an elimination order of least degree or least fill."""
    near = {n: set(g.near(n)) - {n} for n in g.nodes}
    bags, place = [], {}
    left = set(g.nodes)

    def cost(n):
        if heuristic == "min_degree":
            return len(near[n])
        return sum(1 for u, v in combinations(sorted(near[n]), 2) if v not in near[u])

    heap = [(cost(n), n) for n in g.nodes]
    heapq.heapify(heap)
    while left:
        c, n = heapq.heappop(heap)
        if n not in left or c != cost(n):
            if n in left:
                heapq.heappush(heap, (cost(n), n))
            continue
        left.discard(n)
        place[n] = len(bags)
        bags.append({n, *near[n]})
        around = near.pop(n)
        for u in around:
            near[u] |= around - {u}
            near[u].discard(n)
            heapq.heappush(heap, (cost(u), u))
    parent = []
    for i, bag in enumerate(bags):
        later = [place[n] for n in bag if place[n] > i]
        parent.append(min(later) if later else (i + 1 if i + 1 < len(bags) else None))
    return max((len(b) for b in bags), default=1) - 1, bags, parent


def valid_decomposition(g, bags: dict, tree: list[tuple]) -> bool:
    """Every node and edge is in a bag, and each node's bags hang together in the tree."""
    where: dict = {}
    for b, nodes in bags.items():
        for n in nodes:
            where.setdefault(n, set()).add(b)
    if any(n not in where for n in g.nodes):
        return False
    if any(not (where[u] & where[v]) for u, v, _ in g.edges()):
        return False
    joined: dict = {b: set() for b in bags}
    for x, y in tree:
        joined[x].add(y)
        joined[y].add(x)
    for mine in where.values():
        seen, todo = set(), [next(iter(mine))]
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo.extend((joined[b] & mine) - seen)
        if seen != mine:
            return False
    return True


# ---------------------------------------------------------------- centrality


def brandes(g, source, weighted: bool):
    """Dependencies of ``source`` on every node (shortest paths by weight or hops)."""
    dist, count, before, order = {source: 0}, {source: 1}, {source: []}, []
    heap, done = [(0, source)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, w in g.out[u].items():
            nd = d + (w if weighted else 1)
            if v not in dist or nd < dist[v]:
                dist[v], count[v], before[v] = nd, count[u], [u]
                heapq.heappush(heap, (nd, v))
            elif nd == dist[v] and v not in done and u != v:
                count[v] += count[u]
                before[v].append(u)
    depend = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for u in before[v]:
            depend[u] += count[u] / count[v] * (1 + depend[v])
    depend.pop(source, None)
    return depend
