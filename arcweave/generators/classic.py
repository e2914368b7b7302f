"""Deterministic families: weight 1, ids 0 .. n-1.

Large families are ranges and arithmetic, so they are made in parallel and
never pass through the driver; only small fixed graphs are literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, _spark, edge_frame


def _ids(n: int) -> DataFrame:
    return _spark().range(max(0, n)).select("id")


def create_nodes(n: int) -> DataFrame:
    return _ids(n).select("id", F.lit(None).cast("string").alias("data"))


def _graph(n: int, edges: DataFrame | None, directed: bool) -> Graph:
    """From edges (src, dst), each once; a directed family also gets what ``edges`` says and no more."""
    if edges is None:
        return Graph(create_nodes(n), edge_frame([]), directed)
    if not directed:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return Graph(create_nodes(n), edges.select("src", "dst", F.lit(1).cast("long").alias("w")), directed)


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    made = [F.struct(F.expr(a).cast("long").alias("src"), F.expr(b).cast("long").alias("dst")) for a, b in pairs]
    return df.select(F.explode(F.array(*made)).alias("e")).select("e.src", "e.dst")


def _literal(n: int, pairs: list[tuple[int, int]], directed: bool) -> Graph:
    return _graph(n, edge_frame([(a, b, 1) for a, b in pairs]).select("src", "dst"), directed)


def _clique(lo: int, size: int) -> DataFrame:
    a = _ids(size).select((F.col("id") + lo).alias("src"))
    return a.select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(lo + size))).alias("dst")).where(F.col("dst") < lo + size)


def empty_graph(n: int, directed: bool = False) -> Graph:
    return _graph(n, None, directed)


def complete(n: int, directed: bool = False) -> Graph:
    """All pairs, both ways if directed."""
    if n < 2:
        return empty_graph(n, directed)
    up = _clique(0, n)
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if directed else up
    return _graph(n, both, directed)


def cycle(n: int, directed: bool = False) -> Graph:
    """A ring; empty below 3."""
    return _graph(n, _pairs(_ids(n), ("id", f"(id + 1) % {n}")), directed) if n >= 3 else empty_graph(0, directed)


def path(n: int, directed: bool = False) -> Graph:
    return _graph(n, _pairs(_ids(n - 1), ("id", "id + 1")), directed)


def star(n: int, directed: bool = False) -> Graph:
    """Node 0 joined to all others."""
    return _graph(n, _pairs(_ids(n).where("id > 0"), ("0", "id")), directed)


def wheel(n: int, directed: bool = False) -> Graph:
    """A star whose rim is a ring; empty below 4."""
    if n < 4:
        return empty_graph(0, directed)
    return _graph(n, _pairs(_ids(n).where("id > 0"), ("0", "id"), ("id", f"CASE WHEN id = {n - 1} THEN 1 ELSE id + 1 END")), directed)


def grid_2d(rows: int, cols: int, directed: bool = False) -> Graph:
    ids = _ids(rows * cols)
    right = _pairs(ids.where(F.col("id") % cols < cols - 1), ("id", "id + 1"))
    down = _pairs(ids.where(F.col("id") < (rows - 1) * cols), ("id", f"id + {cols}"))
    both = right.unionByName(down)
    if directed:
        both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _graph(rows * cols, both, directed)


def complete_bipartite(m: int, n: int, directed: bool = False) -> Graph:
    if m < 1 or n < 1:
        return empty_graph(m + n, directed)
    edges = _ids(m).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(m).cast("long"), F.lit(m + n - 1).cast("long"))).alias("dst"))
    return _graph(m + n, edges, directed)


def kary_tree(k: int, depth: int, directed: bool = False) -> Graph:
    """The full tree of ``depth`` levels below the root."""
    n = depth + 1 if k == 1 else (k ** (depth + 1) - 1) // (k - 1)
    return complete_kary(n, k, directed)


def complete_kary(n: int, k: int, directed: bool = False) -> Graph:
    """The first n nodes of a k-ary tree, level by level."""
    return _graph(n, _pairs(_ids(n).where("id > 0"), (f"(id - 1) div {k}", "id")), directed)


def binary_tree(depth: int, directed: bool = False) -> Graph:
    return kary_tree(2, depth, directed)


def caterpillar(n: int, spine: int, directed: bool = False) -> Graph:
    """A path of ``spine`` nodes with the other nodes spread evenly as leaves."""
    spine = max(0, min(n, spine))
    if spine == 0:
        return empty_graph(n, directed)
    body = _pairs(_ids(spine - 1), ("id", "id + 1"))
    leaves = _pairs(_ids(n).where(F.col("id") >= spine), (f"(id - {spine}) % {spine}", "id"))
    return _graph(n, body.unionByName(leaves), directed)


def petersen_graph(directed: bool = False) -> Graph:
    """An outer ring, an inner star, and five spokes."""
    return _graph(10, _pairs(_ids(5), ("id", "(id + 1) % 5"), ("id", "id + 5"), ("5 + id", "5 + (id + 2) % 5")), directed)


def hypercube(n: int, directed: bool = False) -> Graph:
    """2**n nodes, joined where one bit differs."""
    ids = _ids(1 << n)
    if n == 0:
        return empty_graph(1, directed)
    bits = ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    edges = bits.select("src", F.expr("src ^ shiftleft(1L, b)").alias("dst"))
    return _graph(1 << n, edges if directed else edges.where("src < dst"), directed)


def ladder(n: int, directed: bool = False) -> Graph:
    """Two rails of n nodes with rungs."""
    rails = _pairs(_ids(n - 1), ("id", "id + 1"), (f"id + {n}", f"id + {n} + 1"))
    return _graph(2 * n, rails.unionByName(_pairs(_ids(n), ("id", f"id + {n}"))), directed)


def circular_ladder(n: int, directed: bool = False) -> Graph:
    """Two rings with rungs; empty below 3."""
    if n < 3:
        return empty_graph(0, directed)
    return _graph(2 * n, _pairs(_ids(n), ("id", f"(id + 1) % {n}"), (f"id + {n}", f"{n} + (id + 1) % {n}"), ("id", f"id + {n}")), directed)


def mobius_ladder(n: int, directed: bool = False) -> Graph:
    """A ring of 2n with opposite nodes joined; empty below 2."""
    if n < 2:
        return empty_graph(0, directed)
    ring = _pairs(_ids(2 * n), ("id", f"(id + 1) % {2 * n}"))
    return _graph(2 * n, ring.unionByName(_pairs(_ids(n), ("id", f"id + {n}"))), directed)


def friendship(n: int, directed: bool = False) -> Graph:
    """n triangles that share node 0."""
    return windmill(n, 3, directed)


def windmill(n: int, k: int, directed: bool = False) -> Graph:
    """n cliques of k nodes that share node 0."""
    if n < 1 or k < 2:
        return empty_graph(1 if n >= 1 or k == 1 else 0, directed)
    total = 1 + n * (k - 1)
    outer = _ids(total).where("id > 0")
    block = F.expr(f"(id - 1) div {k - 1}")
    mates = outer.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, block * (k - 1) + k)).alias("dst"))
    mates = mates.where(F.expr(f"dst > src AND (dst - 1) div {k - 1} = (src - 1) div {k - 1}"))
    return _graph(total, _pairs(outer, ("0", "id")).unionByName(mates), directed)


def book(n: int, directed: bool = False) -> Graph:
    """n triangles that share the edge 0 - 1."""
    pages = _pairs(_ids(n), ("0", "id + 2"), ("1", "id + 2"))
    return _graph(n + 2, pages.unionByName(_pairs(_ids(1), ("0", "1"))), directed)


def crown(n: int, directed: bool = False) -> Graph:
    """Complete bipartite without the matching i - n + i."""
    if n < 1:
        return empty_graph(0, directed)
    edges = _ids(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(n).cast("long"), F.lit(2 * n - 1).cast("long"))).alias("dst"))
    return _graph(2 * n, edges.where(F.col("dst") - F.col("src") != n), directed)


def lollipop(m: int, n: int, directed: bool = False) -> Graph:
    """A clique of m with a path of n behind its last node."""
    tail = _pairs(_ids(m + n - 1).where(F.col("id") >= m - 1), ("id", "id + 1"))
    return _graph(m + n, _clique(0, m).unionByName(tail) if m > 1 else tail, directed)


def barbell(m1: int, m2: int, directed: bool = False) -> Graph:
    """Two cliques of m1 joined by a path of m2 nodes."""
    n = 2 * m1 + m2
    bridge = _pairs(_ids(n).where((F.col("id") >= m1 - 1) & (F.col("id") <= m1 + m2 - 1)), ("id", "id + 1"))
    ends = _clique(0, m1).unionByName(_clique(m1 + m2, m1))
    return _graph(n, ends.unionByName(bridge), directed)


def turan(n: int, r: int, directed: bool = False) -> Graph:
    """Complete multipartite with r parts as even as can be; single orientation if directed."""
    if r < 1 or n < 2:
        return empty_graph(n, directed)
    return _graph(n, _clique(0, n).where(F.expr(f"src % {r} <> dst % {r}")), directed)


def tetrahedron(directed: bool = False) -> Graph:
    return _graph(4, _clique(0, 4), directed)


def cube(directed: bool = False) -> Graph:
    g = hypercube(3)
    return Graph(g.nodes, g.edges, directed)


def octahedron(directed: bool = False) -> Graph:
    """Every pair but the opposite ones i, 5 - i."""
    return _graph(6, _clique(0, 6).where("src + dst <> 5"), directed)


def dodecahedron(directed: bool = False) -> Graph:
    """An outer ring of 5, a ring of 10 between, an inner ring of 5."""
    outer = _pairs(_ids(5), ("id", "(id + 1) % 5"), ("id", "5 + 2 * id"), ("6 + 2 * id", "15 + id"), ("15 + id", "15 + (id + 1) % 5"))
    middle = _pairs(_ids(10), ("5 + id", "5 + (id + 1) % 10"))
    return _graph(20, outer.unionByName(middle), directed)


def icosahedron(directed: bool = False) -> Graph:
    """Two poles, two rings of 5, and a zigzag between the rings."""
    rows = _pairs(
        _ids(5), ("0", "1 + id"), ("11", "6 + id"), ("1 + id", "1 + (id + 1) % 5"), ("6 + id", "6 + (id + 1) % 5"), ("1 + id", "6 + id"), ("1 + id", "6 + (id + 1) % 5")
    )
    return _graph(12, rows, directed)


#: Passages of the eight-room maze (fixed values).
SEDGEWICK = [(0, 2), (0, 5), (0, 7), (1, 7), (2, 6), (3, 4), (3, 5), (4, 5), (4, 6), (4, 7)]


def sedgewick_maze(directed: bool = False) -> Graph:
    return _literal(8, SEDGEWICK, directed)


#: Edges of Tutte's 46-node cubic polyhedron (fixed values).
TUTTE = [
    (0, 1), (0, 2), (0, 3), (1, 4), (1, 26), (2, 10), (2, 11), (3, 18), (3, 19), (4, 5), (4, 33), (5, 6), (5, 29), (6, 7), (6, 27),
    (7, 8), (7, 14), (8, 9), (8, 38), (9, 10), (9, 37), (10, 39), (11, 12), (11, 39), (12, 13), (12, 35), (13, 14), (13, 15),
    (14, 34), (15, 16), (15, 22), (16, 17), (16, 44), (17, 18), (17, 43), (18, 45), (19, 20), (19, 45), (20, 21), (20, 41),
    (21, 22), (21, 23), (22, 40), (23, 24), (23, 27), (24, 25), (24, 32), (25, 26), (25, 31), (26, 33), (27, 28), (28, 29),
    (28, 32), (29, 30), (30, 31), (30, 33), (31, 32), (34, 35), (34, 38), (35, 36), (36, 37), (36, 39), (37, 38), (40, 41),
    (40, 44), (41, 42), (42, 43), (42, 45), (43, 44),
]


def tutte(directed: bool = False) -> Graph:
    return _literal(46, TUTTE, directed)
