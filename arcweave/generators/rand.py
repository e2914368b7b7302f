"""Random models with seeds.

Draws are hashes of (seed, what is drawn), so they don't depend on partitions
or retries.  Models whose pairs are independent are drawn by jumps
(``draws``, ``classes``); those where a draw depends on earlier ones go by
rounds over tables (``attached``).
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.generators import attached, classes
from arcweave.generators.attached import NoGraph
from arcweave.generators.classic import _graph, _ids, empty_graph
from arcweave.generators.draws import around, chosen, distinct_numbers, uniform
from arcweave.model import Graph, node_frame


def _likely_pairs(n: int, top: float, seed: int) -> DataFrame:
    """(src, dst) with src < dst, every pair of 0 .. n - 1 with probability ``top``."""
    rows = _ids(n).select(F.col("id").alias("src"), F.lit(0).alias("run"), (F.lit(n - 1) - F.col("id")).alias("m"), F.lit(float(top)).alias("p"))
    return chosen(rows, seed).select("src", (F.col("src") + F.col("k") + 1).alias("dst"))


def erdos_renyi_gnp(n: int, p: float, seed: int = 0, directed: bool = False) -> Graph:
    """Each pair with probability ``p``, by jumps between chosen pairs within each row."""
    if n < 2 or p <= 0:
        return empty_graph(n, directed)
    if not directed:
        return _graph(n, _likely_pairs(n, p, seed), directed)
    rows = _ids(n).select(F.col("id").alias("src"), F.lit(0).alias("run"), F.lit(n - 1).alias("m"), F.lit(float(p)).alias("p"))
    dst = F.when(F.col("k") < F.col("src"), F.col("k")).otherwise(F.col("k") + 1)
    return _graph(n, chosen(rows, seed).select("src", dst.alias("dst")), directed)


def erdos_renyi_gnm(n: int, m: int, seed: int = 0, directed: bool = False) -> Graph:
    """``m`` different edges (at most all): pairs by number, drawn without repeats."""
    total = n * (n - 1) if directed else n * (n - 1) // 2
    m = min(m, total)
    if m <= 0:
        return empty_graph(n, directed)
    numbers = distinct_numbers(total, m, seed)
    if not directed:
        u, v = around(str(n))
        return _graph(n, numbers.select(u.alias("src"), v.alias("dst")), directed)
    src, at = F.expr(f"k div {n - 1}"), F.expr(f"k % {n - 1}")
    return _graph(n, numbers.select(src.alias("src"), (at + (at >= src).cast("long")).alias("dst")), directed)


def barabasi_albert(n: int, m: int, seed: int = 0, directed: bool = False) -> Graph:
    """Growth by preference for degrees from a clique of max(m, 2); empty if n < m or m < 1."""
    if n < m or m < 1:
        return empty_graph(0, directed)
    return _graph(n, attached.preferential(n, m, seed), directed)


def watts_strogatz(n: int, k: int, p: float, seed: int = 0, directed: bool = False) -> Graph:
    """A ring of k / 2 neighbours each side, ends rewired with probability ``p``; empty if invalid."""
    if n < 3 or k < 2 or k >= n or k % 2 or not 0 <= p <= 1:
        return empty_graph(0, directed)
    return _graph(n, attached.small_world(n, k, p, seed), directed)


def random_tree(n: int, seed: int = 0, directed: bool = False) -> Graph:
    """Each node's parent is any earlier one."""
    parent = F.floor(uniform(seed, F.col("id")) * F.col("id")).cast("long")
    return _graph(n, _ids(n).where("id > 0").select(parent.alias("src"), F.col("id").alias("dst")), directed)


def random_regular(n: int, d: int, seed: int = 0, tries: int = 100) -> Graph:
    """Every degree ``d``, by pairing stubs; empty if impossible or not found in ``tries``."""
    if d >= n or d < 0 or n * d % 2:
        return empty_graph(0, False)
    try:
        return _graph(n, attached.paired(_ids(n).select("id", F.lit(d).cast("long").alias("degree")), seed, tries=tries), False)
    except NoGraph:
        return empty_graph(0, False)


def sbm_with_labels(n: int, k: int, p_in: float, p_out: float, seed: int = 0, directed: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, (id, block)): pairs by probability of their blocks; blocks are id mod k.

    Every row draws once from its own block and once from all others, which
    are numbered by arithmetic, so pairs that aren't drawn are never listed.
    """
    src, j, others = F.col("src"), F.col("k"), max(k - 1, 1)
    if directed:
        same = F.floor((F.lit(n - 1) - F.col("id") % k) / k)
        rest = F.lit(n - 1) - same
        own = src % k + (j + (j >= F.floor(src / k)).cast("long")) * k
        far = F.floor(j / others) * k + j % others + (j % others >= src % k).cast("long")
    else:
        same = F.floor((F.lit(n - 1) - F.col("id")) / k)
        rest = F.lit(n - 1) - F.col("id") - same
        own = src + (j + 1) * k
        far = src + j + F.floor(j / others) + 1
    runs = F.array(*[F.struct(F.lit(i).alias("run"), m.cast("long").alias("m"), F.lit(float(p)).alias("p")) for i, m, p in ((0, same, p_in), (1, rest, p_out))])
    rows = _ids(n).select(F.col("id").alias("src"), F.explode(runs).alias("x")).select("src", "x.*")
    edges = chosen(rows, seed).select("src", F.when(F.col("run") == 0, own).otherwise(far).cast("long").alias("dst"))
    return _graph(n, edges, directed), _ids(n).select("id", (F.col("id") % k).alias("block"))


def sbm(n: int, k: int, p_in: float, p_out: float, seed: int = 0, directed: bool = False) -> Graph:
    return sbm_with_labels(n, k, p_in, p_out, seed, directed)[0]


def dcsbm(n: int, k: int, p_in: float, p_out: float, seed: int = 0, theta: str | Callable[[random.Random], float] = "power_law", gamma: float = 2.5, mean: float = 3.0) -> Graph:
    """Degree-corrected blocks (id mod k); theta by power_law, poisson or a callable."""
    return _graph(n, classes.corrected_blocks(n, k, p_in, p_out, seed, classes.weights(n, seed, theta, gamma, mean)), False)


def hsbm(n: int, branching: int, depth: int, probabilities: list[float], seed: int = 0) -> Graph:
    """Blocks in a tree; ``probabilities[l]`` for pairs whose blocks part at level l (0 the root, ``depth`` the same leaf)."""
    return _graph(n, classes.block_tree(n, branching, depth, probabilities, seed), False)


def configuration_model(degrees: list[int] | DataFrame, seed: int = 0, allow_loops: bool = False, allow_multi: bool = False, tries: int = 100, directed: bool = False) -> Graph:
    """Stubs paired at random; parallel edges collapse where allowed.

    ``degrees`` are those of 0, 1, ..., or rows (id, degree), whose ids are kept.
    """
    if isinstance(degrees, DataFrame):
        edges = attached.paired(degrees, seed, allow_loops, allow_multi, tries).distinct()
        return Graph(degrees.select("id", F.lit(None).cast("string").alias("data")), edges.withColumn("w", F.lit(1).cast("long")), directed)
    rows = node_frame([(i, str(d)) for i, d in enumerate(degrees)]).select("id", F.col("data").cast("long").alias("degree"))
    return _graph(len(degrees), attached.paired(rows, seed, allow_loops, allow_multi, tries), directed)


def randomize_degree_sequence(g: Graph, seed: int = 0, tries: int = 100, allow_loops: bool = True, allow_multi: bool = True) -> Graph:
    """Another graph of the same nodes and degrees, weight 1; repeats of an edge collapse where they are allowed."""
    made = configuration_model(g.degrees().select("id", F.col("degree").cast("long").alias("degree")), seed, allow_loops, allow_multi, tries)
    return Graph(g.nodes, made.edges, False)


def power_law_graph(n: int, gamma: float, seed: int = 0, least: int = 1) -> Graph:
    """Degrees from a power law with exponent ``gamma`` > 2, then stubs paired."""
    if gamma <= 2 or n < 2:
        raise NoGraph("an exponent above 2 and two nodes are needed")
    grown = F.floor(least * F.pow(1 - uniform(seed, F.col("id")), -1 / (gamma - 1)))
    degrees = _ids(n).select("id", F.least(F.lit(n - 1), grown).cast("long").alias("degree"))
    if degrees.agg(F.sum("degree")).first()[0] % 2:
        one = F.when(F.col("degree") < n - 1, 1).otherwise(-1)
        degrees = degrees.withColumn("degree", F.col("degree") + F.when(F.col("id") == 0, one).otherwise(0))
    return configuration_model(degrees, seed, True, True)


def rmat(n: int, m: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, d: float = 0.05, seed: int = 0, directed: bool = True) -> Graph:
    """``m`` draws of edges bit by bit over quadrants; loops, repeats and ids beyond n are dropped."""
    return kronecker_general([[a, b], [c, d]], max(1, (n - 1).bit_length()), m, seed, directed, n)


def kronecker(initiator: list[list[float]], k: int, m: int, seed: int = 0, directed: bool = True) -> Graph:
    return kronecker_general(initiator, k, m, seed, directed)


def kronecker_general(initiator: list[list[float]], k: int, m: int, seed: int = 0, directed: bool = True, n: int | None = None) -> Graph:
    """``m`` draws of edges from the k-th power of a square initiator, one digit at a time."""
    size = len(initiator)
    flat = [x for row in initiator for x in row]
    total, upto, bounds = sum(flat), 0.0, []
    for x in flat:
        upto += x / total
        bounds.append(upto)
    rows = _ids(m)

    def cell(level: int) -> Column:
        u = uniform(seed, F.col("id"), F.lit(level))
        out = F.lit(len(flat) - 1)
        for i in reversed(range(len(flat) - 1)):
            out = F.when(u < bounds[i], i).otherwise(out)
        return out

    s = d = F.lit(0).cast("long")
    for level in range(k):
        rows = rows.withColumn(f"c{level}", cell(level))
        s = s * size + F.expr(f"c{level} div {size}")
        d = d * size + F.col(f"c{level}") % size
    edges = rows.select(s.alias("src"), d.alias("dst")).where("src <> dst").distinct()
    n = n or size**k
    return _graph(n, edges.where((F.col("src") < n) & (F.col("dst") < n)), directed)


def _positions(n: int, seed: int, dims: int) -> DataFrame:
    return _ids(n).select("id", *[uniform(seed, F.col("id"), F.lit(i)).alias(f"x{i}") for i in range(dims)])


def geometric_nd(n: int, radius: float, dims: int = 2, seed: int = 0, metric: str = "euclidean", periodic: bool = False) -> Graph:
    """Random points, joined within ``radius``: cells of that width meet their neighbours only."""
    points = _positions(n, seed, dims)
    cells = max(1, int(1 / radius)) if radius > 0 else 1
    cells = min(cells, 1 << 12)
    at = [F.least(F.floor(F.col(f"x{i}") * cells), F.lit(cells - 1)).cast("int") for i in range(dims)]
    here = points.select("*", *[c.alias(f"c{i}") for i, c in enumerate(at)])
    spread = here
    for i in range(dims):
        around = F.array(F.col(f"c{i}") - 1, F.col(f"c{i}"), F.col(f"c{i}") + 1)
        if periodic:
            around = F.array_distinct(F.transform(around, lambda c: F.pmod(c, F.lit(cells))))
        spread = spread.withColumn(f"c{i}", F.explode(around))
    a, b = here.alias("a"), spread.alias("b")
    met = a.join(b, [F.col(f"a.c{i}") == F.col(f"b.c{i}") for i in range(dims)]).where("a.id < b.id")
    gaps = [F.abs(F.col(f"a.x{i}") - F.col(f"b.x{i}")) for i in range(dims)]
    if periodic:
        gaps = [F.least(x, F.lit(1.0) - x) for x in gaps]
    length = sum(gaps[1:], gaps[0]) if metric == "manhattan" else F.sqrt(sum((x * x for x in gaps[1:]), gaps[0] * gaps[0]))
    return _graph(n, met.where(length <= radius).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct(), False)


def geometric(n: int, radius: float, seed: int = 0, metric: str = "euclidean", periodic: bool = False) -> Graph:
    return geometric_nd(n, radius, 2, seed, metric, periodic)


def waxman(n: int, alpha: float, beta: float, seed: int = 0) -> Graph:
    """Points in the unit square, joined with probability beta * exp(-d / (alpha * sqrt 2))."""
    return _graph(n, classes.by_distance(n, _positions(n, seed, 2), alpha, beta, seed), False)
