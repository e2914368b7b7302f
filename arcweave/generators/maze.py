"""Mazes: spanning trees of a rows x cols grid, by seed.  Cells are r * cols + c, weight 1."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from arcweave.generators.classic import _graph, _ids
from arcweave.generators.rand import uniform
from arcweave.model import Graph, edge_frame
from arcweave.operators.kernels import Sets


def _made(rows: int, cols: int, passages) -> Graph:
    return _graph(rows * cols, edge_frame([(a, b, 1) for a, b in passages]).select("src", "dst"), False)


def _near(rows: int, cols: int, cell: int) -> list[int]:
    r, c = divmod(cell, cols)
    return [cell + d for ok, d in ((r > 0, -cols), (c > 0, -1), (c < cols - 1, 1), (r < rows - 1, cols)) if ok]


def binary_tree(rows: int, cols: int, seed: int = 0, bias: str = "ne") -> Graph:
    """Each cell opens one of its two biased neighbours (ne, nw, se, sw); cells are independent, so relational."""
    up, side = bias[0] == "n", bias[1] == "e"
    r, c = F.expr(f"id div {cols}"), F.col("id") % cols
    vertical = r > 0 if up else r < rows - 1
    horizontal = c < cols - 1 if side else c > 0
    v, h = F.col("id") + (-cols if up else cols), F.col("id") + (1 if side else -1)
    to = F.when(vertical & horizontal, F.when(uniform(seed, F.col("id")) < 0.5, v).otherwise(h)).when(vertical, v).when(horizontal, h)
    return _graph(rows * cols, _ids(rows * cols).select(F.col("id").alias("src"), to.alias("dst")).where("dst IS NOT NULL"), False)


def sidewinder(rows: int, cols: int, seed: int = 0) -> Graph:
    """Runs in a row, each with one way up; the first row is one corridor."""
    r, out = random.Random(seed), []
    for y in range(rows):
        run = []
        for x in range(cols):
            cell = y * cols + x
            run.append(cell)
            if x < cols - 1 and (y == 0 or r.random() < 0.5):
                out.append((cell, cell + 1))
            elif y > 0:
                up = r.choice(run)
                out.append((up - cols, up))
                run = []
    return _made(rows, cols, out)


def growing_tree(rows: int, cols: int, strategy: str = "last", seed: int = 0) -> Graph:
    """Grow from active cells picked last, first, at random, in the middle, or mixed (last or random)."""
    if rows * cols == 0:
        return _made(rows, cols, [])
    r, out = random.Random(seed), []
    active = [r.randrange(rows * cols)]
    seen = set(active)
    pick = {
        "last": lambda: len(active) - 1, "first": lambda: 0, "random": lambda: r.randrange(len(active)), "middle": lambda: len(active) // 2,
        "mix": lambda: len(active) - 1 if r.random() < 0.5 else r.randrange(len(active)),
    }[strategy]
    while active:
        i = pick()
        free = [n for n in _near(rows, cols, active[i]) if n not in seen]
        if free:
            n = r.choice(free)
            out.append((active[i], n))
            seen.add(n)
            active.append(n)
        else:
            active.pop(i)
    return _made(rows, cols, out)


def recursive_backtracker(rows: int, cols: int, seed: int = 0) -> Graph:
    """Depth first."""
    return growing_tree(rows, cols, "last", seed)


def prim_simplified(rows: int, cols: int, seed: int = 0) -> Graph:
    """A random active cell grows."""
    return growing_tree(rows, cols, "random", seed)


def prim_true(rows: int, cols: int, seed: int = 0) -> Graph:
    """Random weights; the least edge at the frontier is opened."""
    import heapq

    if rows * cols == 0:
        return _made(rows, cols, [])
    r, out, seen = random.Random(seed), [], {0}
    heap = [(r.random(), 0, n) for n in _near(rows, cols, 0)]
    heapq.heapify(heap)
    while heap:
        _, a, b = heapq.heappop(heap)
        if b not in seen:
            seen.add(b)
            out.append((a, b))
            for n in _near(rows, cols, b):
                if n not in seen:
                    heapq.heappush(heap, (r.random(), b, n))
    return _made(rows, cols, out)


def hunt_and_kill(rows: int, cols: int, seed: int = 0) -> Graph:
    """Walk until stuck, then scan for a free cell beside the maze."""
    if rows * cols == 0:
        return _made(rows, cols, [])
    r, out = random.Random(seed), []
    cell = r.randrange(rows * cols)
    seen = {cell}
    scan = 0
    while len(seen) < rows * cols:
        free = [n for n in _near(rows, cols, cell) if n not in seen]
        if free:
            n = r.choice(free)
            out.append((cell, n))
        else:
            n = next(c for c in [*range(scan, rows * cols), *range(scan)] if c not in seen and any(x in seen for x in _near(rows, cols, c)))
            scan = n
            out.append((n, r.choice([x for x in _near(rows, cols, n) if x in seen])))
        seen.add(n)
        cell = n
    return _made(rows, cols, out)


def aldous_broder(rows: int, cols: int, seed: int = 0) -> Graph:
    """A uniform walk; the way into each new cell is opened."""
    if rows * cols == 0:
        return _made(rows, cols, [])
    r, out = random.Random(seed), []
    cell = r.randrange(rows * cols)
    seen = {cell}
    while len(seen) < rows * cols:
        n = r.choice(_near(rows, cols, cell))
        if n not in seen:
            seen.add(n)
            out.append((cell, n))
        cell = n
    return _made(rows, cols, out)


def wilson(rows: int, cols: int, seed: int = 0) -> Graph:
    """Loop-erased walks to the maze."""
    if rows * cols == 0:
        return _made(rows, cols, [])
    r, out, seen = random.Random(seed), [], {0}
    for start in range(rows * cols):
        step, cell = {}, start
        while cell not in seen:
            step[cell] = r.choice(_near(rows, cols, cell))
            cell = step[cell]
        cell = start
        while cell not in seen:
            seen.add(cell)
            out.append((cell, step[cell]))
            cell = step[cell]
    return _made(rows, cols, out)


def kruskal(rows: int, cols: int, seed: int = 0) -> Graph:
    """Walls in random order, opened between different sets."""
    r, sets = random.Random(seed), Sets()
    walls = [(c, n) for c in range(rows * cols) for n in _near(rows, cols, c) if n > c]
    r.shuffle(walls)
    return _made(rows, cols, [w for w in walls if sets.union(*w)])


def ellers(rows: int, cols: int, seed: int = 0) -> Graph:
    """Row by row, with the sets of one row in memory."""
    r, out, sets = random.Random(seed), [], Sets()
    for y in range(rows):
        last = y == rows - 1
        for x in range(cols - 1):
            a = y * cols + x
            if sets.find(a) != sets.find(a + 1) and (last or r.random() < 0.5):
                sets.union(a, a + 1)
                out.append((a, a + 1))
        if last:
            break
        groups: dict[int, list[int]] = {}
        for x in range(cols):
            groups.setdefault(sets.find(y * cols + x), []).append(y * cols + x)
        for cells in groups.values():
            for a in r.sample(cells, r.randrange(1, len(cells) + 1)):
                sets.union(a, a + cols)
                out.append((a, a + cols))
    return _made(rows, cols, out)


def recursive_division(rows: int, cols: int, seed: int = 0) -> Graph:
    """The whole grid, cut by walls with one gap each."""
    r = random.Random(seed)
    open_ = {(c, n) for c in range(rows * cols) for n in _near(rows, cols, c) if n > c}
    todo = [(0, 0, rows, cols)]
    while todo:
        y, x, h, w = todo.pop()
        if h < 2 and w < 2 or h < 1 or w < 1:
            continue
        if h > w or (h == w and r.random() < 0.5):
            cut, gap = r.randrange(h - 1), r.randrange(w)
            for i in range(w):
                if i != gap:
                    a = (y + cut) * cols + x + i
                    open_.discard((a, a + cols))
            todo += [(y, x, cut + 1, w), (y + cut + 1, x, h - cut - 1, w)]
        else:
            cut, gap = r.randrange(w - 1), r.randrange(h)
            for i in range(h):
                if i != gap:
                    a = (y + i) * cols + x + cut
                    open_.discard((a, a + 1))
            todo += [(y, x, h, cut + 1), (y, x + cut + 1, h, w - cut - 1)]
    return _made(rows, cols, sorted(open_))
