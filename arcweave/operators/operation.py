"""Graph algebra: set operations, products, powers and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, canonical, dense_ids
from arcweave.operators.transform import induced, merge
from arcweave.plans.materialize import materialize

union = merge
compose = merge


def _edges_as(g: Graph, directed: bool) -> DataFrame:
    return canonical(g.arcs() if directed else g.edges, directed).dropDuplicates(["src", "dst"])


def intersection(first: Graph, second: Graph) -> Graph:
    """Nodes and edges in both, with the first's payloads and weights."""
    nodes = first.nodes.join(second.nodes.select("id"), "id", "left_semi")
    edges = first.edges.join(_edges_as(second, first.directed).select("src", "dst"), ["src", "dst"], "left_semi")
    return Graph(nodes, edges, first.directed)


def difference(first: Graph, second: Graph) -> Graph:
    """Nodes only in the first, and its edges among them that the second lacks."""
    nodes = first.nodes.join(second.nodes.select("id"), "id", "left_anti")
    edges = first.edges.join(_edges_as(second, first.directed).select("src", "dst"), ["src", "dst"], "left_anti")
    return induced(Graph(first.nodes, edges, first.directed), nodes)


def symmetric_difference(first: Graph, second: Graph) -> Graph:
    """Nodes in one graph only, and edges whose ends are both such."""
    a = induced(first, first.nodes.join(second.nodes.select("id"), "id", "left_anti"))
    b = induced(second, second.nodes.join(first.nodes.select("id"), "id", "left_anti"))
    return Graph(a.nodes.unionByName(b.nodes), a.edges.unionByName(_edges_as(b, first.directed)), first.directed)


def disjoint_union(first: Graph, second: Graph) -> Graph:
    """Both side by side; the second's ids move past the first's largest."""
    top = first.nodes.agg(F.max("id").alias("m")).first()["m"]
    by = 0 if top is None else top + 1
    nodes = second.nodes.select((F.col("id") + by).alias("id"), "data")
    edges = _edges_as(second, first.directed).select((F.col("src") + by).alias("src"), (F.col("dst") + by).alias("dst"), "w")
    return Graph(first.nodes.unionByName(nodes), first.edges.unionByName(edges), first.directed)


class _Pair:
    """Two graphs with dense ids, and the pair ids u * |second| + v."""

    def __init__(self, first: Graph, second: Graph):
        self.a, self.b, self.directed = first, second, first.directed
        self.ia = materialize(dense_ids(first.nodes, "id", "i"), "product")
        self.ib = materialize(dense_ids(second.nodes, "id", "i"), "product")
        self.n = self.ib.count()

    def nodes(self) -> DataFrame:
        # a product has a node for every pair: its size is |first| * |second| by definition
        left, right = self.ia.select(F.col("i").alias("u"), F.col("data").alias("x")), self.ib.select(F.col("i").alias("v"), F.col("data").alias("y"))
        return left.join(right, F.lit(True)).select(self._id(F.col("u"), F.col("v")).alias("id"), F.struct(F.col("x").alias("_1"), F.col("y").alias("_2")).alias("data"))

    def _id(self, u: Column, v: Column) -> Column:
        return u * self.n + v

    def _dense(self, edges: DataFrame, ids: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        s, d, w = names
        lo, hi = ids.select(F.col("id").alias("src"), F.col("i").alias(s)), ids.select(F.col("id").alias("dst"), F.col("i").alias(d))
        return edges.join(lo, "src").join(hi, "dst").select(s, d, F.col("w").alias(w))

    def arcs(self, which: str) -> DataFrame:
        g, ids = (self.a, self.ia) if which == "a" else (self.b, self.ib)
        return self._dense(g.arcs(), ids, (f"{which}s", f"{which}d", f"{which}w"))

    def build(self, *parts: DataFrame) -> Graph:
        edges = parts[0]
        for p in parts[1:]:
            edges = edges.unionByName(p)
        edges = canonical(edges, self.directed).groupBy("src", "dst").agg(F.max_by("w", "rank").alias("w"))
        return Graph(self.nodes(), edges, self.directed)

    def row(self, df: DataFrame, src: tuple[Column, Column], dst: tuple[Column, Column], w: tuple[Column, Column], rank: int) -> DataFrame:
        return df.select(
            self._id(*src).alias("src"), self._id(*dst).alias("dst"), F.struct(w[0].alias("_1"), w[1].alias("_2")).alias("w"), F.lit(rank).alias("rank")
        )

    def copies(self, default_first, default_second) -> list[DataFrame]:
        c = F.col
        down = self.arcs("b").join(self.ia.select(c("i").alias("u")), F.lit(True))
        along = self.arcs("a").join(self.ib.select(c("i").alias("v")), F.lit(True))
        return [
            self.row(down, (c("u"), c("bs")), (c("u"), c("bd")), (F.lit(default_first), c("bw")), 0),
            self.row(along, (c("as"), c("v")), (c("ad"), c("v")), (c("aw"), F.lit(default_second)), 1),
        ]

    def crossed(self, rank: int) -> DataFrame:
        c = F.col
        both = self.arcs("a").join(self.arcs("b"), F.lit(True))
        return self.row(both, (c("as"), c("bs")), (c("ad"), c("bd")), (c("aw"), c("bw")), rank)


def cartesian_product(first: Graph, second: Graph, default_first=0, default_second=0) -> Graph:
    """Copies of each graph for each node of the other; weights are pairs."""
    p = _Pair(first, second)
    return p.build(*p.copies(default_first, default_second))


def tensor_product(first: Graph, second: Graph) -> Graph:
    """An edge for each pair of edges."""
    p = _Pair(first, second)
    return p.build(p.crossed(0))


def strong_product(first: Graph, second: Graph, default_first=0, default_second=0) -> Graph:
    """Cartesian and tensor product; the latter's weight where both have an edge."""
    p = _Pair(first, second)
    return p.build(*p.copies(default_first, default_second), p.crossed(2))


def lexicographic_product(first: Graph, second: Graph, default_first=0, default_second=0) -> Graph:
    """Copies of the second for each node of the first, joined wholly along the first's edges."""
    p, c = _Pair(first, second), F.col
    down = p.arcs("b").join(p.ia.select(c("i").alias("u")), F.lit(True))
    inside = p.row(down, (c("u"), c("bs")), (c("u"), c("bd")), (F.lit(default_first), c("bw")), 0)
    pairs = p.ib.select(c("i").alias("v")).join(p.ib.select(c("i").alias("x")), F.lit(True))
    across = p.row(p.arcs("a").join(pairs, F.lit(True)), (c("as"), c("v")), (c("ad"), c("x")), (c("aw"), F.lit(default_second)), 1)
    return p.build(inside, across)


def pairing(a: Column, b: Column) -> Column:
    """Cantor's pairing of two ids."""
    return F.floor((a + b) * (a + b + 1) / 2).cast("long") + b


def line_graph(g: Graph, default: object = 1) -> Graph:
    """A node for each edge (payload: its weight), an edge where two meet head to tail, or share an end if undirected."""
    e = g.edges.select("src", "dst", "w", pairing(F.col("src"), F.col("dst")).alias("id"))
    nodes = e.select("id", F.col("w").alias("data"))
    if g.directed:
        a, b = e.alias("a"), e.alias("b")
        met = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
        met = met.where("src <> dst")
    else:
        ends = e.select("id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"))
        a, b = ends.alias("a"), ends.alias("b")
        met = a.join(b, (F.col("a.end") == F.col("b.end")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    return Graph(nodes, met.distinct().withColumn("w", F.lit(default)), g.directed)


def power(g: Graph, k: int, default: object = 1) -> Graph:
    """An edge to everything within ``k`` hops; new ones weigh ``default``."""
    if k <= 1:
        return g.with_edges(g.edges.withColumn("w", F.lit(default)))
    reach = g.arcs().select("src", "dst").distinct()
    step = materialize(reach, "power")
    frontier = step
    for _ in range(k - 1):
        a, b = frontier.alias("a"), step.alias("b")
        grown = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        frontier = materialize(grown.distinct().join(reach, ["src", "dst"], "left_anti"), "power")
        if frontier.isEmpty():
            break
        reach = reach.unionByName(frontier)
    new = canonical(reach.where("src <> dst"), g.directed).distinct().join(g.edges, ["src", "dst"], "left_anti")
    return g.with_edges(g.edges.unionByName(new.withColumn("w", F.lit(default))))


def is_subgraph(container: Graph, potential: Graph) -> bool:
    """Whether every node and arc of ``potential`` is in ``container``."""
    if not potential.nodes.join(container.nodes.select("id"), "id", "left_anti").isEmpty():
        return False
    return potential.arcs().join(container.arcs().select("src", "dst"), ["src", "dst"], "left_anti").isEmpty()


def isomorphic(first: Graph, second: Graph, max_edges: int = 200_000) -> bool:
    """Whether the two have the same shape: counts and degrees relationally, then a guarded search."""
    from arcweave.operators.kernels import isomorphic as search
    from arcweave.operators.local import Local

    if first.directed != second.directed or first.order() != second.order() or first.edge_count() != second.edge_count():
        return False
    shape = lambda g: g.degrees().groupBy("in_degree", "out_degree").count()
    a, b = shape(first), shape(second)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        return False
    return search(Local.of(first, max_edges), Local.of(second, max_edges))
