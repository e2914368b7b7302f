"""Yes-or-no properties of graphs, from counts where counts decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators import kernels
from arcweave.operators.connectivity import strongly_connected_components, weakly_connected_components
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.traversal import is_acyclic, topological_generations


def _parts(g: Graph) -> int:
    return weakly_connected_components(g).select("component").distinct().count()


def is_weakly_connected(g: Graph) -> bool:
    return _parts(g) <= 1


def is_strongly_connected(g: Graph) -> bool:
    if not g.directed:
        return _parts(g) <= 1
    return strongly_connected_components(g).select("component").distinct().count() <= 1


def is_connected(g: Graph) -> bool:
    """One component; strongly if directed. The empty graph is connected."""
    return is_strongly_connected(g)


def is_tree(g: Graph) -> bool:
    n = g.order()
    return not g.directed and n > 0 and g.edge_count() == n - 1 and _parts(g) == 1


def is_forest(g: Graph) -> bool:
    return not g.directed and g.edge_count() == g.order() - _parts(g)


def _rooted(g: Graph) -> int | None:
    d = g.degrees().groupBy().agg(
        F.count("*").alias("n"), F.count_if(F.col("in_degree") == 0).alias("roots"), F.count_if(F.col("in_degree") == 1).alias("ones"),
        F.min(F.when(F.col("in_degree") == 0, F.col("id"))).alias("root"),
    ).first()
    return d["root"] if g.directed and d["n"] and d["roots"] == 1 and d["ones"] == d["n"] - 1 else None


def is_arborescence(g: Graph) -> bool:
    """One root, one way into every other node, and no cycle."""
    return _rooted(g) is not None and topological_generations(g)[1]


def arborescence_root(g: Graph) -> int | None:
    return _rooted(g) if is_arborescence(g) else None


def is_branching(g: Graph) -> bool:
    """Directed, at most one way into each node, no cycle."""
    return g.directed and g.degrees().where("in_degree > 1").isEmpty() and is_acyclic(g)


def is_complete(g: Graph) -> bool:
    n = g.order()
    if n <= 1:
        return True
    pairs = n * (n - 1) if g.directed else n * (n - 1) // 2
    return g.edges.where("src = dst").isEmpty() and g.edge_count() == pairs


def is_regular(g: Graph, k: int) -> bool:
    """Every degree is ``k`` (both ways if directed); true without nodes."""
    bad = (F.col("in_degree") != k) | (F.col("out_degree") != k) if g.directed else F.col("degree") != k
    return g.degrees().where(bad).isEmpty()


def minimum_degree(g: Graph) -> int:
    return g.degrees().agg(F.min("degree").alias("m")).first()["m"] or 0


def is_chordal(g: Graph, max_edges: int = MAX_EDGES) -> bool:
    return not g.directed and kernels.is_chordal(Local.of(g, max_edges))
