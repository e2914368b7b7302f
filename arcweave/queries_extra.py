"""More registered queries: single operators on the trade graph, generators by arithmetic, round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcweave import datasets as ds
from arcweave.builders import grid
from arcweave.builders.labeled import Labeled
from arcweave.builders.live import Live
from arcweave.functions.semirings import MIN_MAX
from arcweave.generators import classic, maze, rand
from arcweave.model import Graph
from arcweave.operators import approximate, centrality, cliques, connectivity, dag, flow, health, matching, multigraph, operation, paths, planarity, spanning, structure, transform, traversal
from arcweave.queries import DAG, N, ORACLES, QUERIES, _APSP, _CLOSURE, _LINES, _REGION, _lines, _region_ring, dag_trade, edges_of, one_row, trade_cost
from arcweave.render import ascii as art
from arcweave.render import drawings
from arcweave.sources import attribute_formats as af
from arcweave.sources import text_formats as tf


def register(name: str, sql: str | None, f) -> None:
    f.__name__ = name
    QUERIES[name] = f
    if sql is not None:
        ORACLES[name] = sql


def on_trade(name: str, body: str | None, f, view: str = ds.TRADE) -> None:
    """``f(graph)`` gives the rows of ``body`` over the trade views."""
    register(name, None if body is None else f"WITH {view} {body}", lambda spark, sf_dir: f(ds.trade(spark, sf_dir)))


def on_dag(name: str, body: str | None, f) -> None:
    register(name, None if body is None else f"WITH {DAG} {body}", lambda spark, sf_dir: f(dag_trade(spark, sf_dir)))


def pairs(name: str, sql: str, make) -> None:
    register(name, sql, lambda spark, sf_dir: make().edges.select("src", "dst"))


def flags(name: str, sql: str, make) -> None:
    """One row of counts and answers."""
    register(name, sql, lambda spark, sf_dir: one_row(spark, **make(spark, sf_dir)))


# ---- lookups and changes

E3 = "SELECT src, dst, w FROM trade"
on_trade("model_successors", "SELECT dst AS id, w FROM trade WHERE src = 3", lambda g: g.successors(3))
on_trade("model_predecessors", "SELECT src AS id, w FROM trade WHERE dst = 3", lambda g: g.predecessors(3))
on_trade(
    "model_neighbors", "SELECT coalesce(a.dst, b.src) AS id, coalesce(a.w, b.w) AS w FROM (SELECT * FROM trade WHERE src = 3) a FULL JOIN (SELECT * FROM trade WHERE dst = 3) b ON a.dst = b.src",
    lambda g: g.neighbors(3),
)
on_trade("model_remove_node", f"{E3} WHERE src <> 3 AND dst <> 3", lambda g: edges_of(g.remove_node(3)))
on_trade("model_remove_edge", f"{E3} WHERE NOT (src = 3 AND dst = 4)", lambda g: edges_of(g.remove_edge(3, 4)))
on_trade("model_add_node", "SELECT id, data FROM nodes WHERE id <> 3 UNION ALL SELECT 3, 'changed' UNION ALL SELECT 99, 'new'", lambda g: g.add_nodes_from([(3, "changed"), (99, "new")]).nodes)
on_trade("model_add_edge", f"{E3} WHERE NOT (src = 3 AND dst = 4) UNION ALL SELECT 3, 4, -1", lambda g: edges_of(g.add_edges([(3, 4, 7), (3, 4, -1)])))
on_trade("model_add_edge_ensured", f"{E3} UNION ALL SELECT 3, 99, 5", lambda g: edges_of(g.add_edge_ensured(3, 99, 5)))
on_trade(
    "model_add_edge_with_combine", "SELECT src, dst, CASE WHEN src = 3 AND dst = 4 THEN w + 1000 ELSE w END AS w FROM trade",
    lambda g: edges_of(g.add_edge_with_combine(3, 4, 1000, lambda a, b: a + b)),
)
on_trade(
    "model_counts", "SELECT (SELECT COUNT(*) FROM nodes) AS nodes, COUNT(*) AS edges, CAST(COUNT(*) FILTER (WHERE src = 3) AS BIGINT) AS out_degree, CAST(COUNT(*) FILTER (WHERE dst = 3) AS BIGINT) AS in_degree FROM trade",
    lambda g: one_row(g.nodes.sparkSession, nodes=g.order(), edges=g.edge_count(), out_degree=g.out_degree(3), in_degree=g.in_degree(3)),
)
on_trade("model_all_nodes", "SELECT id FROM nodes", lambda g: g.all_nodes())

# ---- transforms

on_trade("transform_subgraph", f"{E3} WHERE src IN (1, 2, 3) AND dst IN (1, 2, 3)", lambda g: edges_of(transform.subgraph(g, [1, 2, 3])))
on_trade("transform_merge", f"{E3} WHERE src <> 1 UNION ALL SELECT src, dst, -w FROM trade WHERE src = 1", lambda g: edges_of(transform.merge(g, g.with_edges(g.edges.where("src = 1").selectExpr("src", "dst", "-w AS w")))))
on_trade("transform_remove_self_loops", f"{E3} WHERE src <> dst", lambda g: edges_of(transform.remove_self_loops(g)))
on_dag("transform_add_self_loops", "SELECT src, dst, w FROM dag UNION ALL SELECT id, id, 1 FROM nodes", lambda g: edges_of(transform.add_self_loops(g)))
on_trade("transform_relabel", "SELECT src * 2 + 1 AS src, dst * 2 + 1 AS dst, w FROM trade", lambda g: edges_of(transform.relabel(g, lambda i: i * 2 + 1)))
on_dag("transform_to_directed", "SELECT src, dst, w FROM dag UNION ALL SELECT dst, src, w FROM dag", lambda g: edges_of(transform.to_directed(transform.to_undirected(g))))
on_trade("transform_update_node", "SELECT id, CASE WHEN id = 3 THEN data || '*' ELSE data END AS data FROM nodes", lambda g: transform.update_node(g, 3, "x", lambda d: F.concat(d, F.lit("*"))).nodes)
on_trade("transform_update_edge", "SELECT src, dst, CASE WHEN src = 3 AND dst = 4 THEN w * 10 ELSE w END AS w FROM trade", lambda g: edges_of(transform.update_edge(g, 3, 4, 0, lambda w: w * 10)))
on_trade("transform_map_edges", "SELECT src, dst, w + 1 AS w FROM trade", lambda g: edges_of(transform.map_edges(g, lambda w: w + 1)))
on_trade("transform_map_nodes_indexed", "SELECT id, data || ':' || id AS data FROM nodes", lambda g: transform.map_nodes_indexed(g, lambda i, d: F.concat_ws(":", d, i.cast("string"))).nodes)

# ---- algebra

register(
    "strong_product_trade",
    _REGION + " SELECT n.id * 5 + c.src AS src, n.id * 5 + c.dst AS dst FROM nodes n CROSS JOIN cyc c UNION SELECT d.src * 5 + r.src, d.dst * 5 + r.src FROM dag d CROSS JOIN cyc r "
    "UNION SELECT d.src * 5 + c.src, d.dst * 5 + c.dst FROM dag d CROSS JOIN cyc c",
    lambda spark, sf_dir: operation.strong_product(dag_trade(spark, sf_dir), _region_ring(spark, sf_dir)).edges.select("src", "dst"),
)
register(
    "lexicographic_product_trade",
    _REGION + " SELECT n.id * 5 + c.src AS src, n.id * 5 + c.dst AS dst FROM nodes n CROSS JOIN cyc c UNION SELECT d.src * 5 + x.src, d.dst * 5 + y.src FROM dag d CROSS JOIN cyc x CROSS JOIN cyc y",
    lambda spark, sf_dir: operation.lexicographic_product(dag_trade(spark, sf_dir), _region_ring(spark, sf_dir)).edges.select("src", "dst"),
)
flags(
    "comparisons_trade", "SELECT true AS part, false AS whole, true AS same_shape",
    lambda spark, sf_dir: (lambda g, d: {"part": operation.is_subgraph(g, d), "whole": operation.is_subgraph(d, g), "same_shape": operation.isomorphic(d, transform.relabel(d, lambda i: 24 - i))})(
        ds.trade(spark, sf_dir), dag_trade(spark, sf_dir)
    ),
)

# ---- multigraphs

register("multigraph_max", f"WITH {_LINES} SELECT src, dst, MAX(w) AS w FROM ln GROUP BY 1, 2", lambda spark, sf_dir: edges_of(_lines(spark, sf_dir).to_simple_graph_max_edges()))
register("multigraph_successors", f"WITH {_LINES} SELECT dst AS id, eid, w FROM ln WHERE src = 1", lambda spark, sf_dir: _lines(spark, sf_dir).successors(1))
register("multigraph_edges_between", f"WITH {_LINES} SELECT eid, w FROM ln WHERE src = 1 AND dst = 2", lambda spark, sf_dir: _lines(spark, sf_dir).edges_between(1, 2))
register("multigraph_remove_node", f"WITH {_LINES} SELECT eid, src, dst, w FROM ln WHERE src <> 1 AND dst <> 1", lambda spark, sf_dir: _lines(spark, sf_dir).remove_node(1).edges)
flags(
    "multigraph_euler", "SELECT true AS circuit, true AS path, CAST(2 AS BIGINT) AS length",
    lambda spark, sf_dir: (lambda g: {"circuit": multigraph.has_eulerian_circuit(g), "path": multigraph.has_eulerian_path(g), "length": len(multigraph.find_eulerian_circuit(g))})(
        multigraph.MultiGraph.from_edges([(0, 1, 1), (0, 1, 1)], directed=False)
    ),
)

# ---- paths, DAGs, connectivity

register("johnson_trade", _APSP + " SELECT src, dst, CAST(w AS BIGINT) AS dist FROM r5", lambda spark, sf_dir: paths.johnson(trade_cost(spark, sf_dir)))
for _name, _f in {
    "dijkstra_trade": lambda g: paths.shortest_path(g, 0, 7).total_weight,
    "bidirectional_trade": lambda g: paths.bidirectional(g, 0, 7).total_weight,
    "a_star_trade": lambda g: paths.a_star(g, 0, 7, lambda n, goal: 0).total_weight,
    "bellman_ford_trade": lambda g: paths.bellman_ford(g, 0, 7)[1].total_weight,
    "yen_trade": lambda g: paths.k_shortest_paths(g, 0, 7, 3)[0].total_weight,
}.items():
    flags(_name, _APSP + " SELECT CAST(w AS BIGINT) AS dist FROM r5 WHERE src = 0 AND dst = 7", lambda spark, sf_dir, f=_f: {"dist": int(f(trade_cost(spark, sf_dir)))})
register(
    "bottleneck_distances_trade",
    f"WITH {ds.TRADE}, r0 AS (SELECT src, dst, w FROM trade WHERE src <> dst)"
    + "".join(f", r{i} AS (SELECT src, dst, min(w) AS w FROM (SELECT * FROM r{i - 1} UNION ALL SELECT a.src, b.dst, greatest(a.w, b.w) FROM r{i - 1} a JOIN r{i - 1} b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY 1, 2)" for i in range(1, 6))
    + " SELECT dst AS id, CAST(w AS BIGINT) AS dist FROM r5 WHERE src = 0",
    lambda spark, sf_dir: paths.single_source_distances(ds.trade(spark, sf_dir), 0, MIN_MAX).where("id <> 0").select("id", F.col("dist").cast("long").alias("dist")),
)
register("dag_descendants_trade", _CLOSURE + " SELECT CAST(3 AS BIGINT) AS id UNION SELECT dst FROM reach WHERE src = 3", lambda spark, sf_dir: dag.descendants(dag.Dag.from_graph(dag_trade(spark, sf_dir)), 3))
register("dag_ancestors_trade", _CLOSURE + " SELECT CAST(9 AS BIGINT) AS id UNION SELECT src FROM reach WHERE dst = 9", lambda spark, sf_dir: dag.ancestors(dag.Dag.from_graph(dag_trade(spark, sf_dir)), 9))
on_dag("dag_sinks_trade", "SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM dag)", lambda g: dag.sinks(dag.Dag.from_graph(g)))
register(
    "lowest_common_ancestors_trade",
    _CLOSURE + ", up AS (SELECT id, id AS a FROM nodes UNION SELECT dst, src FROM reach), c AS (SELECT a AS id FROM up WHERE id = 11 INTERSECT SELECT a FROM up WHERE id = 14) "
    "SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM reach JOIN c d ON d.id = reach.dst WHERE reach.src = c.id)",
    lambda spark, sf_dir: dag.lowest_common_ancestors(dag.Dag.from_graph(dag_trade(spark, sf_dir)), 11, 14),
)
on_dag("acyclic_trade", "SELECT true AS acyclic, CAST(25 AS BIGINT) AS sorted", lambda g: one_row(g.nodes.sparkSession, acyclic=traversal.is_acyclic(g), sorted=len(traversal.topological_sort(g))))
on_trade("acyclic_not_trade", "SELECT true AS cyclic", lambda g: one_row(g.nodes.sparkSession, cyclic=traversal.is_cyclic(g)))
register(
    "dag_distances_trade",
    f"WITH {DAG}, r0 AS (SELECT dst, w FROM dag WHERE src = 0 UNION ALL SELECT 0, 0)" + "".join(
        f", r{i} AS (SELECT dst, min(w) AS w FROM (SELECT * FROM r{i - 1} UNION ALL SELECT d.dst, r.w + d.w FROM r{i - 1} r JOIN dag d ON d.src = r.dst) GROUP BY 1)" for i in range(1, N)
    ) + f" SELECT dst AS id, CAST(w AS BIGINT) AS dist FROM r{N - 1}",
    lambda spark, sf_dir: dag.single_source_distances(dag.Dag.from_graph(dag_trade(spark, sf_dir)), 0),
)
register(
    "dag_longest_from_trade",
    f"WITH {DAG}, r0 AS (SELECT dst, w FROM dag WHERE src = 0 UNION ALL SELECT 0, 0)" + "".join(
        f", r{i} AS (SELECT dst, max(w) AS w FROM (SELECT * FROM r{i - 1} UNION ALL SELECT d.dst, r.w + d.w FROM r{i - 1} r JOIN dag d ON d.src = r.dst) GROUP BY 1)" for i in range(1, N)
    ) + f" SELECT dst AS id, CAST(w AS BIGINT) AS dist FROM r{N - 1}",
    lambda spark, sf_dir: dag.longest_distances_from(dag.Dag.from_graph(dag_trade(spark, sf_dir)), 0),
)
register(
    "bridges_geo", f"WITH {ds.TREE} SELECT src AS u, dst AS v FROM tree",
    lambda spark, sf_dir: connectivity.analyze(transform.to_undirected(ds.geo_tree(spark, sf_dir)))[0],
)
register(
    "articulation_points_geo",
    f"WITH {ds.TREE}, d AS (SELECT id, COUNT(*) AS k FROM (SELECT src AS id FROM tree UNION ALL SELECT dst FROM tree) GROUP BY 1) SELECT id FROM d WHERE k > 1",
    lambda spark, sf_dir: connectivity.analyze(transform.to_undirected(ds.geo_tree(spark, sf_dir)))[1],
)
register(
    "core_numbers_geo", f"WITH {ds.TREE} SELECT DISTINCT unnest([src, dst]) AS id, CAST(1 AS BIGINT) AS core FROM tree",
    lambda spark, sf_dir: connectivity.core_numbers(transform.to_undirected(ds.geo_tree(spark, sf_dir))),
)
register("tarjan_trade", "SELECT CAST(1 AS BIGINT) AS components, CAST(25 AS BIGINT) AS largest", lambda spark, sf_dir: (lambda c: one_row(spark, components=len(c), largest=max(map(len, c))))(connectivity.strong_components_lists(ds.trade(spark, sf_dir))))
register("reachability_estimate_trade", None, lambda spark, sf_dir: connectivity.reachability_estimate(dag_trade(spark, sf_dir)).select("id", F.col("n").cast("long").alias("n")))

# ---- trees, flows, matchings, cliques, structure

_U = "u AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, SUM(w) AS w FROM trade WHERE src <> dst GROUP BY 1, 2)"


def undirected_trade(spark, sf_dir) -> Graph:
    return transform.to_undirected(transform.remove_self_loops(ds.trade(spark, sf_dir)), "sum")


for _name, _f in {"prim_trade": spanning.prim, "boruvka_trade": spanning.boruvka}.items():
    register(_name, ORACLES["kruskal_trade"], lambda spark, sf_dir, f=_f: (lambda r: one_row(spark, total=int(r.total_weight), edges=r.edge_count))(f(undirected_trade(spark, sf_dir))))
flags("wilson_trade", "SELECT CAST(24 AS BIGINT) AS edges", lambda spark, sf_dir: {"edges": spanning.wilson(undirected_trade(spark, sf_dir), 5).edge_count})
register(
    "edmonds_geo", "SELECT (SELECT COUNT(*) FROM region) + (SELECT COUNT(*) FROM nation) + (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM supplier) AS edges",
    lambda spark, sf_dir: one_row(spark, edges=spanning.edmonds(ds.geo_tree(spark, sf_dir), 0).edge_count),
)
flags(
    "flow_algorithms_trade", "SELECT true AS agree, true AS cut_equals_flow",
    lambda spark, sf_dir: (lambda g, rows, all_: {
        "agree": len({r.max_flow for r in all_}) == 1,
        "cut_equals_flow": (lambda s: sum(w for u, v, w in rows if u in s and v not in s))(set(flow.min_cut(all_[0]).source_side)) == all_[0].max_flow,
    })(*(lambda g: (g, [tuple(r) for r in g.edges.select("src", "dst", "w").collect()], [flow.max_flow(g, 0, 1, a) for a in flow.ALGORITHMS]))(ds.trade(spark, sf_dir))),
)
register(
    "global_min_cut_geo", "SELECT CAST(1 AS BIGINT) AS weight",
    lambda spark, sf_dir: one_row(spark, weight=int(flow.global_min_cut(transform.to_undirected(ds.geo_tree(spark, sf_dir))).weight)),
)
flags("blossom_trade", "SELECT CAST(12 AS BIGINT) AS pairs", lambda spark, sf_dir: {"pairs": len(matching.blossom_maximum_matching(undirected_trade(spark, sf_dir))) // 2})
flags(
    "max_clique_trade", f"WITH {ds.TRADE} SELECT CAST(COUNT(*) AS BIGINT) AS size, CAST(COUNT(*) AS BIGINT) AS greedy, CAST(COUNT(*) AS BIGINT) AS colors FROM nodes",
    lambda spark, sf_dir: (lambda g: {"size": len(cliques.max_clique(g)), "greedy": len(approximate.max_clique(g)), "colors": cliques.coloring_dsatur(g).count})(undirected_trade(spark, sf_dir)),
)
flags(
    "structure_trade", "SELECT true AS complete, false AS tree, true AS connected, true AS chordal, false AS planar, CAST(24 AS BIGINT) AS least_degree, CAST(24 AS BIGINT) AS treewidth",
    lambda spark, sf_dir: (lambda g: {
        "complete": structure.is_complete(g), "tree": structure.is_tree(g), "connected": structure.is_connected(g), "chordal": structure.is_chordal(g),
        "planar": planarity.is_planar(g), "least_degree": structure.minimum_degree(g), "treewidth": approximate.treewidth_upper_bound(g),
    })(undirected_trade(spark, sf_dir)),
)
flags(
    "euler_ring", "SELECT true AS circuit, CAST(13 AS BIGINT) AS length, CAST(12 AS BIGINT) AS postman",
    lambda spark, sf_dir: (lambda g: {"circuit": cliques.has_eulerian_circuit(g), "length": len(cliques.find_eulerian_circuit(g)), "postman": int(paths.chinese_postman(g).total_weight)})(classic.cycle(12)),
)
flags("local_efficiency_trade", "SELECT 1.0::DOUBLE AS score", lambda spark, sf_dir: {"score": round(health.average_local_efficiency(transform.map_edges(undirected_trade(spark, sf_dir), lambda w: F.lit(1))), 9)})
register(
    "approximate_closeness_trade", _APSP + f" SELECT src AS id, round({N - 1}.0 / sum(w), 9) AS score FROM r5 GROUP BY 1",
    lambda spark, sf_dir: approximate.closeness(trade_cost(spark, sf_dir), N).select("id", F.round("score", 9).alias("score")),
)
register("approximate_betweenness_trade", None, lambda spark, sf_dir: approximate.betweenness(ds.trade(spark, sf_dir), 5, 1))
register(
    "degree_centrality_trade", f"WITH {ds.TRADE} SELECT src AS id, COUNT(*) / 24.0::DOUBLE AS score FROM trade GROUP BY 1",
    lambda spark, sf_dir: centrality.degree(ds.trade(spark, sf_dir), "out"),
)

# ---- generators

_R = "FROM range({}) t(i)"
pairs("complete_graph", "SELECT a.i AS src, b.i AS dst FROM range(30) a(i) JOIN range(30) b(i) ON a.i < b.i", lambda: classic.complete(30))
pairs("cycle_graph", "SELECT least(i, (i + 1) % 30) AS src, greatest(i, (i + 1) % 30) AS dst FROM range(30) t(i)", lambda: classic.cycle(30))
pairs("path_graph", "SELECT i AS src, i + 1 AS dst FROM range(29) t(i)", lambda: classic.path(30))
pairs("star_graph", "SELECT CAST(0 AS BIGINT) AS src, i + 1 AS dst FROM range(29) t(i)", lambda: classic.star(30))
pairs("wheel_graph", "SELECT CAST(0 AS BIGINT) AS src, i + 1 AS dst FROM range(29) t(i) UNION ALL SELECT i + 1, i + 2 FROM range(28) t(i) UNION ALL SELECT 1, 29", lambda: classic.wheel(30))
pairs("complete_bipartite_graph", "SELECT a.i AS src, b.i + 7 AS dst FROM range(7) a(i) CROSS JOIN range(9) b(i)", lambda: classic.complete_bipartite(7, 9))
pairs("binary_tree_graph", "SELECT (i - 1) // 2 AS src, i AS dst FROM range(1, 63) t(i)", lambda: classic.binary_tree(5))
pairs("complete_kary_graph", "SELECT (i - 1) // 4 AS src, i AS dst FROM range(1, 50) t(i)", lambda: classic.complete_kary(50, 4))
pairs("ladder_graph", "SELECT i AS src, i + 1 AS dst FROM range(9) t(i) UNION ALL SELECT i + 10, i + 11 FROM range(9) t(i) UNION ALL SELECT i, i + 10 FROM range(10) t(i)", lambda: classic.ladder(10))
pairs(
    "circular_ladder_graph", "SELECT least(i, (i + 1) % 10) AS src, greatest(i, (i + 1) % 10) AS dst FROM range(10) t(i) UNION ALL SELECT 10 + least(i, (i + 1) % 10), 10 + greatest(i, (i + 1) % 10) FROM range(10) t(i) UNION ALL SELECT i, i + 10 FROM range(10) t(i)",
    lambda: classic.circular_ladder(10),
)
pairs("mobius_ladder_graph", "SELECT least(i, (i + 1) % 20) AS src, greatest(i, (i + 1) % 20) AS dst FROM range(20) t(i) UNION ALL SELECT i, i + 10 FROM range(10) t(i)", lambda: classic.mobius_ladder(10))
pairs("friendship_graph", "SELECT CAST(0 AS BIGINT) AS src, i + 1 AS dst FROM range(20) t(i) UNION ALL SELECT 2 * i + 1, 2 * i + 2 FROM range(10) t(i)", lambda: classic.friendship(10))
pairs("windmill_graph", "SELECT CAST(0 AS BIGINT) AS src, i + 1 AS dst FROM range(12) t(i) UNION ALL SELECT a.i, b.i FROM range(1, 13) a(i) JOIN range(1, 13) b(i) ON a.i < b.i AND (a.i - 1) // 3 = (b.i - 1) // 3", lambda: classic.windmill(4, 4))
pairs("book_graph", "SELECT CAST(0 AS BIGINT) AS src, i + 2 AS dst FROM range(8) t(i) UNION ALL SELECT 1, i + 2 FROM range(8) t(i) UNION ALL SELECT 0, 1", lambda: classic.book(8))
pairs("crown_graph", "SELECT a.i AS src, b.i + 8 AS dst FROM range(8) a(i) JOIN range(8) b(i) ON a.i <> b.i", lambda: classic.crown(8))
pairs("lollipop_graph", "SELECT a.i AS src, b.i AS dst FROM range(6) a(i) JOIN range(6) b(i) ON a.i < b.i UNION ALL SELECT i + 5, i + 6 FROM range(4) t(i)", lambda: classic.lollipop(6, 4))
pairs("barbell_graph", "SELECT a.i + k.i AS src, b.i + k.i AS dst FROM range(5) a(i) JOIN range(5) b(i) ON a.i < b.i CROSS JOIN (VALUES (0), (8)) k(i) UNION ALL SELECT i + 4, i + 5 FROM range(4) t(i)", lambda: classic.barbell(5, 3))
pairs("caterpillar_graph", "SELECT i AS src, i + 1 AS dst FROM range(4) t(i) UNION ALL SELECT (i - 5) % 5, i FROM range(5, 20) t(i)", lambda: classic.caterpillar(20, 5))
pairs("petersen_graph", "SELECT least(i, (i + 1) % 5) AS src, greatest(i, (i + 1) % 5) AS dst FROM range(5) t(i) UNION ALL SELECT i, i + 5 FROM range(5) t(i) UNION ALL SELECT 5 + least(i, (i + 2) % 5), 5 + greatest(i, (i + 2) % 5) FROM range(5) t(i)", classic.petersen_graph)
pairs("octahedron_graph", "SELECT a.i AS src, b.i AS dst FROM range(6) a(i) JOIN range(6) b(i) ON a.i < b.i AND a.i + b.i <> 5", classic.octahedron)
pairs("cube_graph", "SELECT a.i AS src, b.i AS dst FROM range(8) a(i) JOIN range(8) b(i) ON a.i < b.i AND bit_count(xor(a.i, b.i)) = 1", classic.cube)
pairs("tetrahedron_graph", "SELECT a.i AS src, b.i AS dst FROM range(4) a(i) JOIN range(4) b(i) ON a.i < b.i", classic.tetrahedron)
flags(
    "literal_graphs", "SELECT CAST(69 AS BIGINT) AS tutte, CAST(30 AS BIGINT) AS dodecahedron, CAST(30 AS BIGINT) AS icosahedron, CAST(10 AS BIGINT) AS maze, true AS regular, true AS planar",
    lambda spark, sf_dir: {
        "tutte": classic.tutte().edge_count(), "dodecahedron": classic.dodecahedron().edge_count(), "icosahedron": classic.icosahedron().edge_count(), "maze": classic.sedgewick_maze().edge_count(),
        "regular": structure.is_regular(classic.tutte(), 3) and structure.is_regular(classic.icosahedron(), 5) and structure.is_regular(classic.dodecahedron(), 3),
        "planar": planarity.is_planar(classic.tutte()) and planarity.is_planar(classic.icosahedron()),
    },
)
flags(
    "random_models", "SELECT CAST(50 AS BIGINT) AS gnm, CAST(97 AS BIGINT) AS preferential, CAST(40 AS BIGINT) AS small_world, true AS tree, true AS regular, CAST(7 AS BIGINT) AS configured",
    lambda spark, sf_dir: {
        "gnm": rand.erdos_renyi_gnm(20, 50, 1).edge_count(), "preferential": rand.barabasi_albert(50, 2, 1).edge_count(), "small_world": rand.watts_strogatz(20, 4, 0.3, 1).edge_count(),
        "tree": structure.is_tree(rand.random_tree(40, 1)), "regular": structure.is_regular(rand.random_regular(20, 3, 1), 3), "configured": rand.configuration_model([3, 3, 2, 2, 2, 2], 1).edge_count(),
    },
)
register("random_blocks", None, lambda spark, sf_dir: rand.sbm(60, 3, 0.5, 0.02, 3).edges.select("src", "dst"))
register("random_rmat", None, lambda spark, sf_dir: rand.rmat(64, 300, seed=5).edges.select("src", "dst"))
register("random_geometric", None, lambda spark, sf_dir: rand.geometric(100, 0.15, 5).edges.select("src", "dst"))
flags(
    "mazes", "SELECT CAST(" + " + ".join(["99"] * 11) + " AS BIGINT) AS edges",
    lambda spark, sf_dir: {"edges": sum(m(10, 10, 3).edges.count() for m in (
        maze.binary_tree, maze.sidewinder, maze.recursive_backtracker, maze.hunt_and_kill, maze.aldous_broder, maze.kruskal, maze.prim_simplified, maze.prim_true, maze.ellers,
        maze.recursive_division, lambda r, c, s: maze.growing_tree(r, c, "mix", s),
    ))},
)

# ---- formats, renderers, builders

_BACK = f"WITH {DAG} SELECT src, dst, CAST(w AS DOUBLE) AS w FROM dag"


def round_trip(name: str, through) -> None:
    register(name, _BACK, lambda spark, sf_dir: through(dag_trade(spark, sf_dir)).edges.select("src", "dst", F.col("w").cast("double").alias("w")))


_LIST = tf.ListOptions(weighted=True)
round_trip("io_edge_list", lambda g: tf.parse_edge_list(tf.serialize_edge_list(g)))
round_trip("io_adjacency", lambda g: tf.parse_adjacency(tf.serialize_adjacency(g, _LIST), _LIST))
round_trip("io_matrix", lambda g: tf.from_matrix(tf.to_matrix(g)[1]))
round_trip("io_matrix_market", lambda g: transform.relabel(tf.parse_matrix_market(tf.serialize_matrix_market(g)).graph, lambda i: i - 1))
round_trip("io_pajek", lambda g: transform.relabel(tf.parse_pajek(tf.serialize_pajek(g)).graph, lambda i: i - 1))
round_trip("io_tgf", lambda g: tf.parse_tgf(tf.serialize_tgf(g, tf.TgfOptions(edge_label=str)), edge=float).graph)
for _dialect in ("generic", "networkx"):
    round_trip(f"io_json_{_dialect}", lambda g, d=_dialect: af.parse_json(af.render_json(g, d)))
for _dialect in ("d3", "cytoscape", "vis_js"):
    round_trip(f"io_json_{_dialect}", lambda g, d=_dialect: af.parse_json(af.render_json(g, d)))  # undirected, but src < dst here
round_trip("io_gdf", lambda g: af.weights_from(af.parse_gdf(af.serialize_gdf_weighted(g))))
round_trip("io_graphml", lambda g: af.weights_from(af.parse_graphml(af.serialize_graphml(g))))
on_dag(
    "render_lines", "SELECT CAST((SELECT COUNT(*) FROM dag) + (SELECT COUNT(*) FROM nodes) + 3 AS BIGINT) AS dot, CAST((SELECT COUNT(*) FROM dag) + (SELECT COUNT(*) FROM nodes) + 1 AS BIGINT) AS mermaid",
    lambda g: one_row(g.nodes.sparkSession, dot=drawings.render_dot(g).count("\n"), mermaid=drawings.render_mermaid(g).count("\n")),
)
flags("render_grid", "SELECT CAST(21 AS BIGINT) AS lines, CAST(21 AS BIGINT) AS unicode_lines", lambda spark, sf_dir: (lambda g: {"lines": art.grid_to_string(g, 10, 10).count("\n") + 1, "unicode_lines": art.grid_to_string_unicode(g, 10, 10).count("\n") + 1})(maze.kruskal(10, 10, 2)))
flags(
    "builder_labels", "SELECT CAST(3 AS BIGINT) AS nodes, CAST(2 AS BIGINT) AS edges, CAST(2 AS BIGINT) AS id, CAST(7 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS left_over",
    lambda spark, sf_dir: (lambda b, live: {
        "nodes": b.to_graph().order(), "edges": b.to_graph().edge_count(), "id": b.get_id("c"), "pending": live.pending_count(), "left_over": live.sync(Graph.empty())[1].edge_count(),
    })(Labeled.from_list([("a", "b", 1), ("b", "c", 2)]), Live.create().add_edge("A", "B", 1).add_edge("B", "C", 2).remove_edge("A", "B").remove_node("C")),
)
pairs(
    "grid_knight", "WITH c AS (SELECT i, i // 8 AS r, i % 8 AS c FROM range(64) t(i)) SELECT a.i AS src, b.i AS dst FROM c a JOIN c b ON abs(a.r - b.r) * abs(a.c - b.c) = 2",
    lambda: grid.from_2d_list_with_topology([["."] * 8 for _ in range(8)], grid.knight).graph,
)
