"""Queries over graphs that grow with the tables and have cycles, bridges and several components, and lookups by row."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave import datasets as ds
from arcweave.builders import grid
from arcweave.generators import rand
from arcweave.model import Graph
from arcweave.operators import connectivity, structure
from arcweave.operators.disjoint_set import DisjointSet
from arcweave.plans.materialize import materialize
from arcweave.queries import edges_of, one_row
from arcweave.queries_extra import flags, on_trade, pairs, register
from arcweave.sources import text_formats as tf


def rings(spark, sf_dir) -> Graph:
    """A hub for each nation, joined to every customer's first order; a customer's orders are a path.

    Customers with an even key and three orders or more close theirs to a ring,
    so half the steps are bridges and half are not.
    """
    customer = ds.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey").cast("long") + ds.PART).alias("hub"))
    orders = ds.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, "o_custkey")
    own, step = Window.partitionBy("o_custkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    placed = orders.select(
        "o_orderkey", "o_custkey", "hub", F.lead("o_orderkey").over(step).alias("following"), F.min("o_orderkey").over(own).alias("first"), F.count("*").over(own).alias("n"),
    )
    at = F.col("o_orderkey")
    link = lambda when, s, d: F.when(when, F.struct(s.alias("src"), d.alias("dst")))
    links = F.array(
        link(F.col("following").isNotNull(), at, F.col("following")),
        link(at == F.col("first"), at, F.col("hub")),
        link(F.col("following").isNull() & (F.col("n") >= 3) & (F.col("o_custkey") % 2 == 0), F.col("first"), at),
    )
    edges = placed.select(F.explode(F.array_compact(links)).alias("e")).select("e.*", F.lit(1).cast("long").alias("w"))
    return Graph.from_frames(None, materialize(edges, "rings"), False)


RINGS = f"""placed AS (
  SELECT o_orderkey, o_custkey, CAST(c_nationkey AS BIGINT) + {ds.PART} AS hub,
         LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following,
         MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS first, COUNT(*) OVER (PARTITION BY o_custkey) AS n,
         o_custkey % 2 = 0 AND COUNT(*) OVER (PARTITION BY o_custkey) >= 3 AS ring
  FROM orders JOIN customer ON o_custkey = c_custkey),
rings AS (
  SELECT o_orderkey AS src, following AS dst, NOT ring AS bridge FROM placed WHERE following IS NOT NULL
  UNION ALL SELECT o_orderkey, hub, true FROM placed WHERE o_orderkey = first
  UNION ALL SELECT first, o_orderkey, false FROM placed WHERE following IS NULL AND ring)"""
_CORES = f"""{RINGS}, cores AS (
  SELECT o_orderkey AS id, CAST(CASE WHEN ring THEN 2 ELSE 1 END AS BIGINT) AS core FROM placed
  UNION ALL SELECT hub, CAST(CASE WHEN COUNT(*) FILTER (WHERE ring AND o_orderkey = first) >= 2 THEN 2 ELSE 1 END AS BIGINT) FROM placed GROUP BY 1)"""


def on_rings(name: str, body: str, f, view: str = RINGS) -> None:
    register(name, f"WITH {view} {body}", lambda spark, sf_dir: f(rings(spark, sf_dir)))


on_rings("bridges_rings", "SELECT src AS u, dst AS v FROM rings WHERE bridge", lambda g: connectivity.analyze(g)[0])
on_rings(
    "articulation_points_rings",
    "SELECT o_orderkey AS id FROM placed WHERE (o_orderkey = first AND n > 1) OR (o_orderkey <> first AND following IS NOT NULL AND NOT ring) "
    "UNION ALL SELECT hub FROM placed WHERE o_orderkey = first GROUP BY 1 HAVING COUNT(*) > 1",
    lambda g: connectivity.analyze(g)[1],
)
on_rings("core_numbers_rings", "SELECT id, core FROM cores", connectivity.core_numbers, _CORES)
on_rings("shell_decomposition_rings", "SELECT core, id FROM cores", connectivity.shell_decomposition, _CORES)
on_rings(
    "k_core_rings", "SELECT src, dst FROM rings JOIN cores a ON a.id = src JOIN cores b ON b.id = dst WHERE a.core >= 2 AND b.core >= 2",
    lambda g: connectivity.k_core(g, 2).edges.select("src", "dst"), _CORES,
)
on_rings("degeneracy_rings", "SELECT MAX(core) AS degeneracy FROM cores", lambda g: one_row(g.nodes.sparkSession, degeneracy=int(connectivity.degeneracy(g))), _CORES)
on_rings(
    "connected_components_rings", "SELECT o_orderkey AS id, MIN(o_orderkey) OVER (PARTITION BY hub) AS component FROM placed UNION ALL SELECT hub, MIN(o_orderkey) FROM placed GROUP BY 1",
    connectivity.connected_components,
)
on_rings(
    "structure_rings",
    "SELECT (SELECT COUNT(*) FROM rings) = (SELECT COUNT(*) FROM placed) AS forest, COUNT(DISTINCT hub) = 1 AS connected, CAST(1 AS BIGINT) AS least_degree FROM placed",
    lambda g: one_row(g.nodes.sparkSession, forest=structure.is_forest(g), connected=structure.is_connected(g), least_degree=int(structure.minimum_degree(g))),
)
on_rings(
    "disjoint_set_rings",
    "SELECT COUNT(*) + COUNT(DISTINCT hub) AS size, COUNT(DISTINCT hub) AS sets, MIN(o_orderkey) AS root, COUNT(DISTINCT hub) = 1 AS joined FROM placed",
    lambda g: (lambda d, lo, hi: one_row(g.nodes.sparkSession, size=d.size(), sets=d.count_sets(), root=int(d.find(lo)[1]), joined=d.connected(lo, hi)))(
        DisjointSet.from_pairs(g.edges.selectExpr("src AS x", "dst AS y")), *_far_apart(g)
    ),
)


def _far_apart(g: Graph) -> tuple[int, int]:
    """The smallest node, and one of another component (itself where there is no other)."""
    parts = connectivity.connected_components(g)
    r = parts.agg(F.min("id").alias("lo"), F.max_by("id", "component").alias("hi")).first()
    return r["lo"], r["hi"]


# ---- lookups and changes by row

on_trade("model_successor_ids", "SELECT dst AS id FROM trade WHERE src = 3", lambda g: g.successor_ids(3))
on_trade("model_predecessor_ids", "SELECT src AS id FROM trade WHERE dst = 3", lambda g: g.predecessor_ids(3))
on_trade("model_neighbor_ids", "SELECT dst AS id FROM trade WHERE src = 3 UNION SELECT src FROM trade WHERE dst = 3", lambda g: g.neighbor_ids(3))
on_trade("model_all_edges", "SELECT src, dst, w FROM trade", lambda g: g.all_edges())
on_trade("io_to_edges", "SELECT src, dst, w FROM trade", tf.to_edges)
on_trade(
    "io_to_list", "SELECT src AS id, dst, w FROM trade",
    lambda g: tf.to_list(g).select("id", F.explode("neighbors").alias("x")).select("id", "x.*"),
)
on_trade(
    "model_membership",
    "SELECT COUNT(*) > 0 AS has_edge, false AS has_no_edge, (SELECT data FROM nodes WHERE id = 3) AS node, true AS has_node, false AS has_no_node, CAST(coalesce(SUM(w), 0) AS BIGINT) AS edge_data, (SELECT COUNT(*) FROM nodes) AS node_count FROM trade WHERE src = 3 AND dst = 4",
    lambda g: one_row(
        g.nodes.sparkSession, has_edge=g.has_edge(3, 4), has_no_edge=g.has_edge(3, 99), node=g.node(3), has_node=g.has_node(3), has_no_node=g.has_node(99), edge_data=int(g.edge_data(3, 4) or 0), node_count=g.node_count(),
    ),
)
on_trade("model_add_one_node", "SELECT id, data FROM nodes UNION ALL SELECT 99, 'new'", lambda g: g.add_node(99, "new").nodes)
on_trade("model_add_keys", "SELECT id, CASE WHEN id < 2 THEN 'x' ELSE data END AS data FROM nodes UNION ALL SELECT 99, 'x'", lambda g: g.add_nodes_from_keys([0, 1, 99], "x").nodes)
_BUT = "SELECT src, dst, CAST(w AS BIGINT) AS w FROM trade WHERE NOT (src = 3 AND dst = 4) UNION ALL SELECT 3, 4, CAST({} AS BIGINT)"
on_trade("model_add_simple_edges", _BUT.format(1), lambda g: edges_of(g.add_simple_edges([(3, 4)])))
on_trade("model_add_unweighted_edges", _BUT.format("NULL"), lambda g: edges_of(g.add_unweighted_edges([(3, 4)])))
on_trade("model_try_add_edge", _BUT.format(7), lambda g: edges_of(g.try_add_edge(3, 4, 7)[0]))
on_trade("model_try_add_edges", _BUT.format(8), lambda g: edges_of(g.try_add_edges([(3, 4, 7), (3, 4, 8)])[0]))
on_trade("model_try_add_simple_edges", _BUT.format(1), lambda g: edges_of(g.try_add_simple_edges([(3, 4)])[0]))
on_trade("model_try_add_unweighted_edges", _BUT.format("NULL"), lambda g: edges_of(g.try_add_unweighted_edges([(3, 4)])[0]))
on_trade("model_try_add_combined", _BUT.format("(SELECT coalesce(SUM(w), 0) FROM trade WHERE src = 3 AND dst = 4) + 5"), lambda g: edges_of(g.try_add_edge_with_combine(3, 4, 5, lambda a, b: a + b)[0]))
on_trade("model_edge_ensured_with", "SELECT id, data FROM nodes UNION ALL SELECT 99, 'made 99'", lambda g: g.add_edge_ensured_with(lambda i: f"made {i}", 3, 99, 5).nodes)
on_trade(
    "model_missing_ends", "SELECT true AS one, true AS many, true AS simple, true AS bare",
    lambda g: one_row(
        g.nodes.sparkSession, one=g.try_add_edge(3, 99, 1)[0] is None, many=g.try_add_edges([(3, 4, 1), (99, 3, 1)])[0] is None, simple=g.try_add_simple_edges([(99, 3)])[0] is None,
        bare=g.try_add_unweighted_edges([(3, 99)])[0] is None,
    ),
)
pairs("model_from_unweighted", "SELECT i AS src, i * i % 31 AS dst FROM range(31) t(i)", lambda: Graph.from_unweighted_edges([(i, i * i % 31) for i in range(31)]))
pairs("model_from_adjacency", "SELECT i AS src, j AS dst FROM range(20) a(i) JOIN range(20) b(j) ON (i * j) % 7 = 1", lambda: Graph.from_adjacency_list([(i, [(j, 1) for j in range(20) if i * j % 7 == 1]) for i in range(20)]))

# ---- random models where chance is certain: every pair of its kind once

_PAIRS = "SELECT a.i AS src, b.i AS dst FROM range({0}) a(i) JOIN range({0}) b(i) ON a.i < b.i"
pairs("random_gnp_sure", _PAIRS.format(40), lambda: rand.erdos_renyi_gnp(40, 1.0, 1))
pairs("random_blocks_within", _PAIRS.format(61) + " AND a.i % 3 = b.i % 3", lambda: rand.sbm(61, 3, 1.0, 0.0, 1))
pairs("random_blocks_between", "SELECT a.i AS src, b.i AS dst FROM range(61) a(i) JOIN range(61) b(i) ON a.i % 3 <> b.i % 3", lambda: rand.sbm(61, 3, 0.0, 1.0, 1, True))
register("random_block_labels", "SELECT i AS id, i % 3 AS block FROM range(61) t(i)", lambda spark, sf_dir: rand.sbm_with_labels(61, 3, 0.5, 0.1, 1)[1])
pairs("random_tree_blocks", _PAIRS.format(48) + " AND a.i % 8 // 2 = b.i % 8 // 2", lambda: rand.hsbm(48, 2, 3, [0.0, 0.0, 1.0, 1.0], 1))
pairs("random_waxman_sure", _PAIRS.format(30), lambda: rand.waxman(30, 1e12, 1.0, 1))
pairs("random_space_sure", _PAIRS.format(30), lambda: rand.geometric_nd(30, 2.0, 3, 1))

# ---- boards

_CELLS = "WITH c AS (SELECT i, i // 8 AS r, i % 8 AS c FROM range(64) t(i)) SELECT a.i AS src, b.i AS dst FROM c a JOIN c b ON a.i <> b.i AND "
_BOARD = [["."] * 8 for _ in range(8)]
pairs("grid_bishop", _CELLS + "abs(a.r - b.r) = 1 AND abs(a.c - b.c) = 1", lambda: grid.from_2d_list_with_topology(_BOARD, grid.bishop).graph)
pairs("grid_queen", _CELLS + "greatest(abs(a.r - b.r), abs(a.c - b.c)) = 1", lambda: grid.from_2d_list_with_topology(_BOARD, grid.queen).graph)
pairs("grid_rook", _CELLS + "abs(a.r - b.r) + abs(a.c - b.c) = 1", lambda: grid.from_2d_list(_BOARD).graph)
_ROUND = _CELLS + "{} (((a.r - b.r + 8) % 8) IN (0, 1, 7)) AND (((a.c - b.c + 8) % 8) IN (0, 1, 7))"
pairs("toroidal_queen", _ROUND.format(""), lambda: grid.toroidal_from_2d_list_with_topology(_BOARD, grid.queen).graph)
pairs("toroidal_bishop", _ROUND.format("a.r <> b.r AND a.c <> b.c AND"), lambda: grid.toroidal_from_2d_list_with_topology(_BOARD, grid.bishop).graph)
flags(
    "grid_places", "SELECT CAST(19 AS BIGINT) AS id, CAST(2 AS BIGINT) AS r, CAST(3 AS BIGINT) AS c, 10.0::DOUBLE AS manhattan, 7.0::DOUBLE AS chebyshev, 2.0::DOUBLE AS toroidal",
    lambda spark, sf_dir: {
        "id": grid.coord_to_id(2, 3, 8), "r": grid.id_to_coord(19, 8)[0], "c": grid.id_to_coord(19, 8)[1], "manhattan": float(grid.manhattan_distance(0, 31, 8)), "chebyshev": float(grid.chebyshev_distance(0, 31, 8)),
        "toroidal": float(grid.toroidal_manhattan_distance(0, 63, 8, 8)),
    },
)
