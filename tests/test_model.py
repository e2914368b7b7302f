import pytest
from conftest import rows
from pyspark.sql import functions as F

from arcweave.model import Graph, MissingNode
from arcweave.operators import transform as t


def edges(g):
    return rows(g.edges, "src", "dst", "w")


def test_edges_and_degrees(spark):
    g = Graph.from_edges([(0, 1, 4), (0, 2, 2), (1, 0, 1), (0, 1, 5)])
    assert edges(g) == [(0, 1, 5), (0, 2, 2), (1, 0, 1)]
    assert rows(g.degrees()) == [(0, 2, 1, 3), (1, 1, 1, 2), (2, 0, 1, 1)]
    assert rows(g.neighbors(0)) == [(1, 5), (2, 2)]
    assert (g.order(), g.edge_count(), g.degree(0), g.has_edge(1, 0), g.edge_data(0, 2)) == (3, 3, 3, True, 2)
    u = Graph.from_edges([(2, 1, 7), (1, 1, 3)], directed=False)
    assert edges(u) == [(1, 1, 3), (1, 2, 7)]
    assert (u.degree(1), u.has_edge(2, 1), u.has_edge(1, 2)) == (3, True, True)


def test_missing_nodes(spark):
    g = Graph.empty().add_node(1, "a")
    with pytest.raises(MissingNode):
        g.add_edge(1, 2, 3)
    assert g.try_add_edge(3, 4, 1)[1] == "Nodes 3 and 4 do not exist"
    assert g.try_add_edge(3, 1, 1)[1].startswith("Source node 3")
    assert edges(g.add_edge_ensured(1, 2, 3)) == [(1, 2, 3)]
    assert edges(g.add_node(2, "b").add_edge(1, 2, 5).add_edge_with_combine(1, 2, 3, lambda a, b: a + b)) == [(1, 2, 8)]
    assert rows(g.add_node(1, "z").nodes) == [(1, "z")]
    assert rows(g.add_node(2, "b").add_edge(1, 2, 5).remove_node(1).edges) == []
    assert Graph.from_adjacency_list([(1, [(2, 3)]), (5, [])]).order() == 3


def test_transforms(spark):
    g = Graph.from_edges([(1, 2, 5), (1, 3, 15), (2, 3, 3)])
    assert edges(t.filter_edges(g, lambda s, d, w: w >= 10)) == [(1, 3, 15)]
    assert edges(t.transpose(g)) == [(2, 1, 5), (3, 1, 15), (3, 2, 3)]
    assert edges(t.map_edges(g, lambda w: w * 2))[0] == (1, 2, 10)
    assert len(edges(t.complement(g))) == 3
    assert edges(t.contract(g, 1, 2)) == [(1, 3, 18)]
    assert edges(t.subgraph(g, [1, 2])) == [(1, 2, 5)]
    assert edges(t.normalize_node_ids(g)) == [(0, 1, 5), (0, 2, 15), (1, 2, 3)]
    assert edges(t.to_undirected(Graph.from_edges([(1, 2, 5), (2, 1, 3)]), "sum")) == [(1, 2, 8)]
    assert len(edges(t.add_self_loops(g))) == 6
    assert edges(t.ego_graph(g, 1, 1)) == edges(g)
    assert edges(t.transitive_reduction(g)) == [(1, 2, 5), (2, 3, 3)]
    assert edges(t.transitive_closure(Graph.from_edges([(1, 2, 1), (2, 3, 2)]))) == [(1, 2, 1), (1, 3, 3), (2, 3, 2)]
    assert edges(t.update_edge(g, 1, 2, 0, lambda w: w + 1))[0] == (1, 2, 6)
    assert edges(t.relabel(g, lambda i: i * 10))[0] == (10, 20, 5)


def test_quotient(spark):
    g = Graph.from_edges([(1, 3, 1), (2, 3, 1), (3, 4, 1)]).add_nodes_from([(1, 10), (2, 20), (3, 30), (4, 40)])
    blocks = spark.createDataFrame([(1, 100), (2, 100), (3, 200), (4, 200)], "id long, block long")
    q = t.quotient_graph(g, blocks)
    assert rows(q.nodes) == [(100, 30), (200, 70)]
    assert edges(q) == [(100, 200, 2)]
    assert t.quotient_graph(g, blocks, lambda a, b: a + b, lambda a, b: a).nodes.count() == 2


def test_algebra(spark):
    from arcweave.operators import operation as o

    a, b = Graph.from_edges([(1, 2, 1), (2, 3, 1)]), Graph.from_edges([(2, 3, 9)])
    assert edges(o.intersection(a, b)) == [(2, 3, 1)]
    assert edges(o.union(a, b)) == [(1, 2, 1), (2, 3, 9)]
    d = o.difference(a, Graph.empty().add_node(3, None))
    assert (rows(d.nodes, "id"), edges(d)) == ([(1,), (2,)], [(1, 2, 1)])
    s = o.symmetric_difference(Graph.from_edges([(1, 2, 1)]), b)
    assert (rows(s.nodes, "id"), edges(s)) == ([(1,), (3,)], [])
    assert edges(o.disjoint_union(a, b)) == [(1, 2, 1), (2, 3, 1), (6, 7, 9)]
    k2 = Graph.from_edges([(0, 1, 1)], directed=False)
    assert o.cartesian_product(k2, k2).edge_count() == 4
    assert o.tensor_product(k2, k2).edge_count() == 2
    assert o.strong_product(k2, k2).edge_count() == 6
    assert o.lexicographic_product(k2, k2).edge_count() == 6
    path = Graph.from_edges([(0, 1, 1), (1, 2, 1), (2, 3, 1)], directed=False)
    assert o.line_graph(path).edge_count() == 2
    assert o.power(path, 2).edge_count() == 5
    assert o.is_subgraph(a, Graph.from_edges([(1, 2, 5)]))
    ring = Graph.from_edges([(5, 7, 1), (7, 6, 1), (6, 5, 1)], directed=False)
    tri = Graph.from_edges([(0, 1, 1), (1, 2, 1), (0, 2, 1)], directed=False)
    assert o.isomorphic(tri, ring) and not o.isomorphic(tri, path)


def test_empty_graph(spark):
    g = Graph.empty(False)
    assert g.order() == 0 and rows(g.degrees()) == [] and rows(t.add_self_loops(g).edges) == []
    assert rows(t.normalize_node_ids(g).nodes) == []
    assert g.edges.where(F.col("src") > 0).count() == 0


def test_multigraph(spark):
    from arcweave.operators import multigraph as m

    mg = m.MultiGraph.from_edges([(0, 1, 5), (0, 1, 3), (1, 2, 1)], directed=False)
    assert mg.edge_count(1, 0) == 2 and mg.degree(1) == 3
    assert edges(mg.to_simple_graph_min_edges()) == [(0, 1, 3), (1, 2, 1)]
    assert edges(mg.to_simple_graph()) == [(0, 1, 5), (1, 2, 1)]
    assert edges(mg.to_simple_graph_sum_edges()) == [(0, 1, 8), (1, 2, 1)]
    two = m.MultiGraph.from_edges([(0, 1, 1), (0, 1, 1)], directed=False)
    assert m.has_eulerian_circuit(two) and len(m.find_eulerian_circuit(two)) == 2
    g2, eid = two.add_edge(1, 2, 4)
    assert eid == 2 and g2.size() == 3 and m.bfs(g2, 0) == [0, 1, 2] and m.dfs(g2, 0) == [0, 1, 2]
    assert m.has_eulerian_path(g2) and sorted(m.find_eulerian_path(g2)) == [0, 1, 2]


def test_disjoint_set(spark):
    from arcweave.operators.disjoint_set import DisjointSet

    d = DisjointSet.from_pairs([(1, 2), (2, 3), (5, 6)])
    assert d.connected(1, 3) and not d.connected(1, 5)
    assert (d.size(), d.count_sets()) == (5, 2)
    assert d.union(3, 5).count_sets() == 1
    assert d.add(9).count_sets() == 3
    assert DisjointSet.empty().size() == 0
