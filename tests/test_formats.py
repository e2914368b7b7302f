import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from arcweave.builders import grid
from arcweave.builders.labeled import Labeled, from_labeled_frame
from arcweave.builders.live import Live, apply_log
from arcweave.generators import classic, maze, rand
from arcweave.model import Graph
from arcweave.operators import structure
from arcweave.operators.local import Local
from arcweave.operators.multigraph import MultiGraph
from arcweave.render import ascii, drawings
from arcweave.sources import attribute_formats as af
from arcweave.sources import text_formats as tf

G = [(0, 1, 1.5), (0, 2, 2.0), (2, 1, 3.0)]


def edges(g):
    return rows(g.edges, "src", "dst", "w")


def test_edge_lists(spark, tmp_path):
    g = Graph.from_edges(G)
    text = tf.serialize_edge_list(g)
    assert text.splitlines()[0] == "0 1 1.500000"
    assert edges(tf.parse_edge_list(text)) == G
    assert edges(tf.parse_edge_list("# c\n1,2\n\n3\t4 5 # x")) == [(1, 2, 1.0), (3, 4, 5.0)]
    with pytest.raises(tf.ParseError, match="line 2"):
        tf.parse_edge_list("1 2\nx y")
    lines = spark.createDataFrame([(x,) for x in ["# c", "1 2", "", "3,4,5"]], "value string")
    assert edges(tf.scan_edge_list(lines)) == [(1, 2, 1.0), (3, 4, 5.0)]
    with pytest.raises(Exception, match="not an edge"):
        tf.scan_edge_list(spark.createDataFrame([("1 x",)], "value string")).edges.collect()
    assert [r[0] for r in tf.edge_list_lines(g).collect()] == text.splitlines()


def test_adjacency_and_matrix(spark):
    g = Graph.from_edges(G)
    o = tf.ListOptions(weighted=True)
    assert edges(tf.parse_adjacency(tf.serialize_adjacency(g, o), o)) == G
    assert tf.to_list(g).count() == 3
    ids, m = tf.to_matrix(g)
    assert ids == [0, 1, 2] and m == [[0, 1.5, 2.0], [0, 0, 0], [0, 3.0, 0]]
    assert edges(tf.from_matrix(m)) == G
    with pytest.raises(tf.ParseError):
        tf.from_matrix([[0, 1]])
    assert tf.serialize_matrix(g).splitlines()[0] == "0 1.5 2"


def test_matrix_market_pajek_tgf(spark):
    g = Graph.from_edges([(1, 2, 1.5), (1, 3, 2.0), (3, 2, 3.0)])
    back = tf.parse_matrix_market(tf.serialize_matrix_market(g))
    assert edges(back.graph) == edges(g) and not back.warnings
    sym = tf.parse_matrix_market("%%MatrixMarket matrix coordinate pattern symmetric\n% c\n3 3 2\n2 1\n9 1\n")
    assert edges(sym.graph) == [(1, 2, 1.0)] and sym.warnings and not sym.graph.directed
    with pytest.raises(tf.ParseError):
        tf.parse_matrix_market("nothing")
    pj = tf.parse_pajek(tf.serialize_pajek(g))
    assert edges(pj.graph) == edges(g) and pj.graph.node(1) == "1"
    assert tf.parse_pajek('*Vertices 2\n1 "a b"\n2 c\n*Edges\n1 2 4\nx\n').graph.node(1) == "a b"
    tg = tf.parse_tgf("1 first\n2\n#\n1 2 label\nbad\n")
    assert rows(tg.graph.nodes) == [(1, "first"), (2, None)] and edges(tg.graph) == [(1, 2, "label")] and len(tg.warnings) == 1
    assert "#" in tf.serialize_tgf(g).splitlines()
    with pytest.raises(tf.ParseError):
        tf.parse_tgf("1 a\n1 b\n#\n")


def test_attribute_formats(spark, tmp_path):
    g = Graph.from_edges(G).add_nodes_from([(0, "zero, or \"none\""), (1, "one"), (2, "<two>")])
    for dialect in af.FORMATS:
        text = af.render_json(g, dialect)
        assert af.detect_format(text) == dialect
        back = af.parse_json(text)
        assert len(edges(back)) == 3 and back.order() == 3
    assert edges(af.parse_json(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "value": 2}]}))) == [(0, 1, 2)]
    gdf = af.parse_gdf(af.serialize_gdf(g))
    assert dict(rows(gdf.nodes.select("id", F.element_at("data", "label"))))[0] == 'zero, or "none"'
    assert edges(af.weights_from(af.parse_gdf(af.serialize_gdf_weighted(g)))) == G
    ml = af.parse_graphml(af.serialize_graphml(g))
    assert edges(af.weights_from(ml)) == G and dict(rows(ml.nodes.select("id", F.element_at("data", "label"))))[2] == "<two>"
    assert af.try_parse_graphml("<x/>")[0] is None
    path = str(tmp_path / "g.graphml")
    af.write_graphml(g, path)
    assert edges(af.weights_from(af.read_graphml(path))) == G
    assert af.scan_graphml_nodes(path).count() == 3
    assert rows(af.scan_graphml_edges(path), "src", "dst") == [(0, 1), (0, 2), (2, 1)]
    af.write_json(g, str(tmp_path / "g.json"))
    assert len(edges(af.read_json(str(tmp_path / "g.json")))) == 3
    af.write_gdf(g, str(tmp_path / "g.gdf"))
    assert af.read_gdf(str(tmp_path / "g.gdf")).order() == 3
    assert af.try_read_graphml(str(tmp_path / "missing"))[0] is None


def test_renderers(spark, tmp_path):
    g = Graph.from_edges([(0, 1, 5), (1, 2, 3)])
    dot = drawings.render_dot(g, drawings.path_to_options(drawings.default_dot_options, [0, 1]))
    assert dot.startswith("digraph G {") and "0 -> 1" in dot and dot.count("penwidth") == 3
    und = Graph.from_edges([(0, 1, 5)], directed=False)
    assert "0 -- 1" in drawings.render_dot(und) and "0 ---" in drawings.render_mermaid(und)
    mer = drawings.render_mermaid(g, drawings.mst_to_options(drawings.default_mermaid_options, [(0, 1, 5)]))
    assert mer.startswith("graph TD") and "classDef" in mer and '0 -->|"5"| 1' in mer
    cut = drawings.render_mermaid(g, drawings.cut_to_options(drawings.default_mermaid_options, [0], [1, 2]))
    assert ":::sourceSide" in cut and ":::sinkSide" in cut
    assert "lightblue" in drawings.render_dot(g, drawings.cut_to_options(drawings.default_dot_options, [0], [1]))
    assert drawings.matching_to_options(drawings.default_dot_options, {0: 1, 1: 0}).edges == {(0, 1)}
    mg = MultiGraph.from_edges([(1, 0, 1), (0, 1, 2)], directed=False)
    assert drawings.render_dot_multi(mg).count("--") == 2 and drawings.render_mermaid_multi(mg).count("---") == 2
    drawings.write_dot(g, str(tmp_path / "g.dot"))
    assert (tmp_path / "g.dot").read_text() == drawings.render_dot(g)
    m = Graph.from_edges([(0, 1, 1), (1, 3, 1), (2, 3, 1)], directed=False)
    assert ascii.grid_to_string(m, 2, 2, {0: "S"}) == "+---+---+\n| S     |\n+---+   +\n|       |\n+---+---+"
    assert ascii.grid_to_string_unicode(m, 2, 2).splitlines()[0] == "┌───────┐"
    ring = grid.toroidal_from_2d_list([["."] * 3 for _ in range(3)], directed=False).graph
    assert ascii.toroidal_to_string(ring, 3, 3).splitlines()[2][0] == "<"
    assert "↕" in ascii.toroidal_to_string_unicode(ring, 3, 3)


def test_builders(spark):
    b = Labeled.from_list([("a", "b", 1), ("b", "c", 2)])
    assert b.to_registry() == {"a": 0, "b": 1, "c": 2} and b.successors("b") == [("c", 2)] and b.predecessors("a") == [] and b.successors("x") is None
    assert edges(b.to_graph()) == [(0, 1, 1), (1, 2, 2)] and b.next_id() == 3
    frame = spark.createDataFrame([("b", "a", 1), ("b", "c", 2)], "from_label string, to_label string, w long")
    assert edges(from_labeled_frame(frame)) == [(1, 0, 1), (1, 2, 2)]
    live = Live.create().add_edge("A", "B", 1).add_edge("B", "C", 2).remove_edge("A", "B").remove_node("C")
    assert live.pending_count() == 7
    done, g = live.sync(Graph.empty())
    assert rows(g.nodes) == [(0, "A"), (1, "B")] and edges(g) == [] and done.pending_count() == 0
    again, g2 = done.add_edge("C", "A", 3).sync(g)
    assert again.get_id("C") == 3 and edges(g2) == [(3, 0, 3)]


def test_log_replay(spark):
    r = random.Random(3)
    log, live = [], {}
    nodes = {}
    for seq in range(300):
        s, d = r.randrange(8), r.randrange(8)
        op = r.choice(["add_edge"] * 4 + ["remove_edge", "remove_node", "add_node"])
        if op == "add_edge" and (s not in nodes or d not in nodes):
            op = "add_node"
        log.append((seq, op, s, d, f"n{seq}", seq))
        if op == "add_node":
            nodes[s] = f"n{seq}"
        elif op == "remove_node":
            nodes.pop(s, None)
            live = {e: w for e, w in live.items() if s not in e}
        elif op == "add_edge":
            live[(s, d)] = seq
        else:
            live.pop((s, d), None)
    df = spark.createDataFrame(log, "seq long, op string, src long, dst long, label string, w long")
    start = Graph.empty()
    g = apply_log(start, df)
    assert rows(g.nodes) == sorted(nodes.items()) and edges(g) == sorted((s, d, w) for (s, d), w in live.items())
    half = apply_log(apply_log(start, df.where("seq < 150")), df.where("seq >= 150"))
    assert edges(half) == edges(g) and rows(half.nodes) == rows(g.nodes)


def test_stream(spark, tmp_path):
    from arcweave.streaming.live import LiveGraph, degree_stream

    schema = "seq long, op string, src long, dst long, label string, w long"
    spark.createDataFrame([(1, "add_node", 1, None, "a", None), (2, "add_node", 2, None, "b", None), (3, "add_edge", 1, 2, None, 5)], schema).write.parquet(str(tmp_path / "log"))
    live = LiveGraph(Graph.empty())
    live.start(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), str(tmp_path / "cp")).awaitTermination(120)
    assert edges(live.graph) == [(1, 2, 5)] and live.batches == 1
    events = spark.createDataFrame([("2024-01-01 00:00:00", 1, 2), ("2024-01-01 00:01:00", 1, 3)], "ts string, src long, dst long").withColumn("ts", F.to_timestamp("ts"))
    assert rows(degree_stream(events), "id", "degree") == [(1, 2), (2, 1), (3, 1)]


def test_grids(spark):
    g = grid.from_2d_list([["S", "."], ["#", "E"]], grid.avoiding("#"))
    assert edges(g.graph) == [(0, 1, 1), (1, 0, 1), (1, 3, 1), (3, 1, 1)]
    assert g.find_node(lambda d: d == "E") == 3 and g.get_cell(1, 0) == "#" and g.get_cell(5, 5) is None
    assert grid.manhattan_distance(0, 3, 2) == 2 and grid.chebyshev_distance(0, 3, 2) == 1 and grid.octile_distance(0, 3, 2) == pytest.approx(2**0.5)
    t = grid.toroidal_from_2d_list([["."] * 4 for _ in range(4)])
    assert t.graph.edge_count() == 64 and grid.toroidal_manhattan_distance(0, 15, 4, 4) == 2
    assert grid.from_2d_list_with_topology([["."] * 3 for _ in range(3)], grid.knight).graph.edge_count() == 16


def test_classic_counts(spark):
    want = {
        "complete": (classic.complete(5), 5, 10), "cycle": (classic.cycle(5), 5, 5), "path": (classic.path(5), 5, 4), "star": (classic.star(5), 5, 4), "wheel": (classic.wheel(5), 5, 8),
        "grid": (classic.grid_2d(3, 4), 12, 17), "bipartite": (classic.complete_bipartite(2, 3), 5, 6), "binary": (classic.binary_tree(3), 15, 14),
        "petersen": (classic.petersen_graph(), 10, 15), "hypercube": (classic.hypercube(4), 16, 32), "ladder": (classic.ladder(4), 8, 10), "prism": (classic.circular_ladder(4), 8, 12),
        "mobius": (classic.mobius_ladder(4), 8, 12), "friendship": (classic.friendship(3), 7, 9), "windmill": (classic.windmill(3, 4), 10, 18), "book": (classic.book(3), 5, 7),
        "crown": (classic.crown(4), 8, 12), "lollipop": (classic.lollipop(4, 3), 7, 9), "barbell": (classic.barbell(3, 2), 8, 9), "turan": (classic.turan(6, 3), 6, 12),
        "kary": (classic.kary_tree(3, 2), 13, 12), "completek": (classic.complete_kary(7, 3), 7, 6), "caterpillar": (classic.caterpillar(9, 3), 9, 8),
        "tetra": (classic.tetrahedron(), 4, 6), "cube": (classic.cube(), 8, 12), "octa": (classic.octahedron(), 6, 12), "dodeca": (classic.dodecahedron(), 20, 30),
        "icosa": (classic.icosahedron(), 12, 30), "maze": (classic.sedgewick_maze(), 8, 10), "tutte": (classic.tutte(), 46, 69),
    }
    for name, (g, n, m) in want.items():
        local = Local.of(g)
        assert (len(local.nodes), local.size()) == (n, m), name
    for name, k in (("petersen", 3), ("mobius", 3), ("dodeca", 3), ("icosa", 5), ("octa", 4), ("tutte", 3), ("prism", 3)):
        local = Local.of(want[name][0])
        assert all(len(local.out[x]) == k for x in local.nodes), name
        assert len(local.components()) == 1
    assert classic.wheel(3).order() == 0 and classic.complete(4, True).edge_count() == 12 and classic.empty_graph(3).edge_count() == 0


def test_random_models(spark):
    g = rand.erdos_renyi_gnp(300, 0.05, 1)
    assert abs(g.edge_count() - 0.05 * 300 * 299 / 2) < 250 and edges(g) == edges(rand.erdos_renyi_gnp(300, 0.05, 1))
    d = rand.erdos_renyi_gnp(60, 0.2, 1, True)
    assert d.edges.where("src = dst OR dst > 59").isEmpty() and d.edges.where("dst < src").count() > 100
    assert rand.erdos_renyi_gnm(20, 50, 1).edge_count() == 50 and rand.erdos_renyi_gnm(5, 99, 1, True).edge_count() == 20
    assert rand.barabasi_albert(50, 2, 1).edge_count() == 1 + 48 * 2
    assert rand.watts_strogatz(20, 4, 0.3, 1).edge_count() == 40 and rand.watts_strogatz(20, 3, 0.3).order() == 0
    assert structure.is_tree(rand.random_tree(40, 1))
    r = rand.random_regular(20, 3, 1)
    assert structure.is_regular(r, 3)
    g, labels = rand.sbm_with_labels(60, 3, 0.5, 0.01, 1)
    assert labels.count() == 60 and g.edges.where("src % 3 = dst % 3").count() > g.edges.where("src % 3 <> dst % 3").count()
    assert rand.dcsbm(40, 2, 0.3, 0.05, 1).order() == 40 and rand.hsbm(40, 2, 2, [0.01, 0.1, 0.6], 1).order() == 40
    c = rand.configuration_model([3, 3, 2, 2, 2, 2], 1)
    assert rows(c.degrees(), "degree") == [(2,), (2,), (2,), (2,), (3,), (3,)]
    with pytest.raises(rand.NoGraph):
        rand.configuration_model([1, 1, 1])
    assert rand.randomize_degree_sequence(c, 2).order() == 6 and rand.power_law_graph(50, 2.5, 1).order() == 50
    k = rand.rmat(60, 300, seed=1)
    assert k.edges.where("src >= 60 OR dst >= 60 OR src = dst").isEmpty() and 100 < k.edge_count() <= 300
    assert rand.kronecker([[0.9, 0.5], [0.5, 0.2]], 5, 100, 1).order() == 32
    geo = rand.geometric(80, 0.2, 4)
    pos = {p["id"]: (p["x0"], p["x1"]) for p in rand._positions(80, 4, 2).collect()}
    near = {(a, b) for a in pos for b in pos if a < b and (pos[a][0] - pos[b][0]) ** 2 + (pos[a][1] - pos[b][1]) ** 2 <= 0.04}
    assert {(s, d) for s, d, _ in edges(geo)} == near
    assert rand.geometric(80, 0.2, 4, periodic=True).edge_count() >= geo.edge_count()
    assert rand.geometric_nd(40, 0.4, 3, 1).order() == 40 and rand.waxman(40, 0.5, 0.8, 1).order() == 40


def test_mazes(spark):
    makers = [maze.binary_tree, maze.sidewinder, maze.recursive_backtracker, maze.hunt_and_kill, maze.aldous_broder, maze.wilson, maze.kruskal, maze.prim_simplified, maze.prim_true, maze.ellers, maze.recursive_division]
    makers += [lambda r, c, s, k=k: maze.growing_tree(r, c, k, s) for k in ("first", "middle", "mix")]
    for make in makers:
        for r, c in ((6, 7), (1, 5), (5, 1)):
            local = Local.of(make(r, c, 3))
            assert local.size() == r * c - 1 and len(local.components()) == 1
            assert all(v - u in (1, c) for u, v, _ in local.edges())


def test_live_graph_goes_on_after_a_restart(spark, tmp_path):
    from arcweave.streaming.live import LiveGraph

    schema = "seq long, op string, src long, dst long, label string, w long"
    inbox, check = str(tmp_path / "in"), str(tmp_path / "check")

    def put(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        live = LiveGraph(Graph.empty())
        live.start(spark.readStream.schema(schema).parquet(inbox), check).awaitTermination()
        return live

    put((1, "add_edge", 1, 2, None, 5), (2, "add_edge", 2, 3, None, 6))
    assert edges(run().graph) == [(1, 2, 5), (2, 3, 6)]
    put((3, "remove_edge", 1, 2, None, None), (4, "add_edge", 3, 4, None, 7))
    live = run()
    assert edges(live.graph) == [(2, 3, 6), (3, 4, 7)] and live.batches == 1
    assert edges(run().graph) == [(2, 3, 6), (3, 4, 7)]  # nothing new: the graph is what was kept
    # a batch that runs again starts from the state before it
    live.apply(spark.createDataFrame([(3, "add_edge", 8, 9, None, 1)], schema), 1)
    assert edges(live.graph) == [(1, 2, 5), (2, 3, 6), (8, 9, 1)]


def test_read_text_refuses_what_is_too_large(spark, tmp_path):
    from arcweave.operators.local import TooLarge
    from arcweave.sources.files import read_text

    (tmp_path / "a.txt").write_text("1 2\n2 3\n")
    assert read_text(str(tmp_path / "a.txt")) == "1 2\n2 3\n"
    with pytest.raises(TooLarge):
        read_text(str(tmp_path / "a.txt"), 7)


def test_jumps_choose_among_all_pairs(spark):
    """With probability 1 every pair of its kind is drawn once, so the numbering of pairs leaves none out."""
    for n, k in ((7, 3), (8, 3), (9, 3), (5, 1), (4, 6)):
        for directed in (False, True):
            pairs = {(a, b) for a in range(n) for b in range(n) if (a != b if directed else a < b)}
            own = {(a, b) for a, b in pairs if a % k == b % k}
            for p_in, p_out, want in ((1, 0, own), (0, 1, pairs - own)):
                got = [(r["src"], r["dst"]) for r in rand.sbm(n, k, p_in, p_out, 1, directed).edges.collect()]
                assert len(got) == len(want) and set(got) == want
    assert {(r["src"], r["dst"]) for r in rand.erdos_renyi_gnp(6, 1.0, 1, True).edges.collect()} == {(a, b) for a in range(6) for b in range(6) if a != b}
    assert rand.hsbm(12, 2, 2, [1, 1, 1]).edge_count() == 66 and rand.waxman(12, 1e9, 1.0).edge_count() == 66
    rows = spark.createDataFrame([(0, 0, 300_000, 0.5), (1, 0, 10**15, 1e-13)], "src long, run int, m long, p double")
    n = {r["src"]: r["count"] for r in rand.chosen(rows, 3).groupBy("src").count().collect()}
    assert abs(n[0] - 150_000) < 1500 and 50 < n[1] < 160
