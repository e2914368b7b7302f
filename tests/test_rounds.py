"""Operators that go by rounds against brute force and the sequential kernels: path tables, dependencies, flows, matchings."""

import random
from collections import defaultdict

import pytest

from arcweave.functions.semirings import MAX_MIN, MIN_PLUS
from arcweave.model import Graph
from arcweave.operators import approximate, centrality, contraction, euler_rounds, flow, flow_rounds, health, kernels, matching, matching_rounds, maximal_cliques, path_tables, paths, ranking, shortest_counts
from arcweave.operators.local import Local
from arcweave.plans.materialize import materialize


def some_edges(draw, nodes, n, low=1, high=4):
    out = {}
    for _ in range(n):
        out[draw.randrange(nodes), draw.randrange(nodes)] = draw.randrange(low, high)
    return out


def graph_of(edges, directed=True):
    return Graph.from_edges([(u, v, w) for (u, v), w in edges.items()], directed)


def best_by_rounds(edges, nodes, s, extend, better, start):
    best = {s: start}
    for _ in nodes:
        for (u, v), w in edges.items():
            if u in best and u != v and v != s:
                c = extend(best[u], w)
                if v not in best or better(c, best[v]):
                    best[v] = c
    return best


@pytest.mark.parametrize("semiring, extend, better, start, whole", [(MIN_PLUS, lambda d, w: d + w, lambda a, b: a < b, 0, sum), (MAX_MIN, min, lambda a, b: a > b, 10**9, min)])
def test_path_rows_are_best_paths(spark, semiring, extend, better, start, whole):
    edges = some_edges(random.Random(1), 14, 40)
    g = graph_of(edges)
    trees = materialize(path_tables.best_trees(g, g.nodes.select("id"), semiring), "trees")
    found = defaultdict(dict)
    for r in path_tables.path_rows(trees).collect():
        found[r["src"], r["dst"]][r["position"]] = r["node"], r["dist"]
    nodes = {n for e in edges for n in e}
    for s in nodes:
        best = best_by_rounds(edges, nodes, s, extend, better, start)
        assert {v for u, v in found if u == s} == set(best)
        for v, c in best.items():
            path = [found[s, v][k] for k in range(len(found[s, v]))]
            steps = [edges[a[0], b[0]] for a, b in zip(path, path[1:], strict=False)]
            assert path[0][0] == s and path[-1][0] == v and (v == s or whole(steps) == c == path[-1][1])


def test_path_ties_take_fewest_hops_then_the_smaller_parent(spark):
    g = Graph.from_edges([(0, 1, 2), (0, 2, 1), (2, 1, 1), (0, 4, 1), (0, 3, 1), (3, 5, 1), (4, 5, 1), (1, 1, 0), (2, 6, 0), (6, 2, 0)])
    assert paths.shortest_path(g, 0, 1).nodes == [0, 1] and paths.shortest_path(g, 0, 5).nodes == [0, 3, 5]
    assert paths.shortest_path(g, 0, 6) == paths.Path([0, 2, 6], 1)
    assert paths.shortest_path(g, 5, 0) is None and paths.shortest_path(g, 77, 77) == paths.Path([77], 0)


def test_long_path_and_pairs(spark):
    g = Graph.from_edges([(i, i + 1, 1) for i in range(70)])
    pairs = spark.createDataFrame([(0, 70), (0, 70), (3, 3), (70, 0), (99, 1)], "src long, dst long")
    rows = sorted(tuple(r) for r in path_tables.shortest_path_rows(g, pairs).collect())
    assert rows == [(0, 70, i, i, i) for i in range(71)] + [(3, 3, 0, 3, 0)]


def test_negative_weights_and_cycles(spark):
    g = Graph.from_edges([(0, 1, 4), (0, 2, 2), (1, 3, -3), (2, 3, 1), (3, 4, 1)])
    assert paths.bellman_ford(g, 0, 4) == ("shortest_path", paths.Path([0, 1, 3, 4], 2)) and paths.bellman_ford(g, 4, 0) == ("no_path", None)
    bad = Graph.from_edges([(0, 1, 1), (1, 2, -3), (2, 1, 1), (2, 3, 1), (9, 0, 1), (5, 6, 1)])
    assert paths.bellman_ford(bad, 9, 3) == ("negative_cycle", None) and paths.bellman_ford(bad, 5, 6)[0] == "shortest_path"
    with pytest.raises(paths.NegativeCycle):
        path_tables.best_trees(Graph.from_edges([(0, 0, -1)]), spark.range(1))


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("weighted", [True, False])
def test_betweenness_equals_the_sequential_sums(spark, directed, weighted):
    g = graph_of(some_edges(random.Random(2), 13, 30), directed)
    local = Local.of(g)
    want = dict.fromkeys(local.nodes, 0.0)
    for s in local.nodes:
        for k, x in dict(kernels.brandes(local, s, weighted)).items():
            want[k] += x * (1.0 if directed else 0.5)
    got = {r["id"]: r["score"] for r in centrality.betweenness(g, weighted).collect()}
    assert got == pytest.approx(want)
    # blocks of sources add up to the same
    parts = {r["id"]: r["part"] for r in shortest_counts.dependencies(g, weighted=weighted, block=4).collect()}
    assert {k: parts.get(k, 0.0) * (1.0 if directed else 0.5) for k in want} == pytest.approx(want)


def test_distance_sums_and_what_they_give(spark):
    g = graph_of(some_edges(random.Random(3), 9, 40))
    local = Local.of(g)
    far = {s: kernels.dijkstra(local.out, s)[0] for s in local.nodes}
    n = len(local.nodes)
    got = {r["id"]: r for r in shortest_counts.distance_sums(g, block=2).collect()}
    assert {s: (r["reached"], r["total"], r["farthest"]) for s, r in got.items()} == {s: (len(d), sum(d.values()), max(d.values())) for s, d in far.items()}
    assert all(len(d) == n for d in far.values())
    assert health.diameter(g) == max(max(d.values()) for d in far.values()) and health.radius(g) == min(max(d.values()) for d in far.values())
    assert approximate.diameter(g, 9) == health.diameter(g)
    with pytest.raises(ValueError, match="above 0"):
        centrality.betweenness(Graph.from_edges([(0, 1, 0)])).collect()
    assert centrality.betweenness(Graph.empty()).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_flow_value_cut_and_balance(spark, seed):
    edges = some_edges(random.Random(seed), 9, 26, 0, 9) | {(0, 1): 5, (7, 8): 4}
    g = graph_of(edges)
    found = flow_rounds.max_flow_rows(g, 0, 8)
    assert found.value == kernels.dinic(Local.of(g), 0, 8)[0] == flow_rounds.max_flow_rows(g, 0, 8, whole=False).value
    side = {r["id"]: r["side"] for r in found.cut.collect()}
    assert sum(w for (u, v), w in edges.items() if u != v and side[u] == "S" and side[v] == "T") == found.value
    net = defaultdict(int)
    for r in found.flow.collect():
        assert 0 < r["f"] <= edges[r["src"], r["dst"]]
        net[r["src"]] -= r["f"]
        net[r["dst"]] += r["f"]
    assert {k: v for k, v in net.items() if v} == ({0: -found.value, 8: found.value} if found.value else {})


def test_flow_without_a_way_and_undirected(spark):
    assert flow_rounds.max_flow_rows(Graph.from_edges([(0, 1, 3), (2, 3, 4)]), 0, 3).value == 0
    assert flow_rounds.max_flow_rows(Graph.from_edges([(1, 0, 3), (1, 2, 2), (0, 2, 1)], False), 0, 2).value == 3
    with pytest.raises(ValueError):
        flow_rounds.max_flow_rows(Graph.empty(), 1, 1)


@pytest.mark.parametrize("seed", [5, 6])
def test_matching_is_largest_and_its_cover_proves_it(spark, seed):
    draw = random.Random(seed)
    pairs = sorted({(draw.randrange(14), draw.randrange(14)) for _ in range(22)})
    found = matching_rounds.bipartite_rows(spark.createDataFrame([*pairs, pairs[0], (None, 3)], "l long, r long"))
    got = [(r["l"], r["r"]) for r in found.pairs.collect()]
    cover = {(r["id"], r["side"]) for r in found.cover.collect()}
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == found.size == len(cover) and set(got) <= set(pairs)
    assert all((u, 0) in cover or (v, 1) in cover for u, v in pairs)


def test_matching_along_a_path_and_odd_cycles(spark):
    path = Graph.from_edges([(i, i + 1, 1) for i in range(21)], False)
    assert len(matching.maximum_matching(path)) == 11 and matching.hopcroft_karp(path)[0] == 1
    with pytest.raises(matching.NotBipartite):
        matching.matching_rows(Graph.from_edges([(0, 1, 1), (1, 2, 1), (2, 0, 1)], False))
    assert matching.maximum_matching(Graph.empty(False)) == []


def test_flow_kernels_agree(spark):
    g = graph_of(some_edges(random.Random(8), 8, 20, 0, 6) | {(0, 1): 3, (6, 7): 3})
    assert flow.edmonds_karp(g, 0, 7).max_flow == flow.dinic(g, 0, 7).max_flow == flow.push_relabel(g, 0, 7).max_flow


def check_tours(spark, edges, directed, closed):
    frame = spark.createDataFrame(edges, "edge long, src long, dst long")
    rows = (euler_rounds.euler_rows if closed else euler_rounds.euler_path_rows)(frame, directed).collect()
    ends = {e: (u, v) for e, u, v in edges}
    assert sorted(r["edge"] for r in rows) == sorted(ends)
    tours = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["position"]):
        tours[r["component"]].append(r)
    for c, tour in tours.items():
        assert [r["position"] for r in tour] == list(range(len(tour))) and c == min(r["edge"] for r in tour)
        assert all(a["dst"] == b["src"] for a, b in zip(tour, tour[1:], strict=False)) and (not closed or tour[-1]["dst"] == tour[0]["src"])
        assert all((r["src"], r["dst"]) == ends[r["edge"]] or not directed and (r["dst"], r["src"]) == ends[r["edge"]] for r in tour)
    return len(tours)


@pytest.mark.parametrize("directed", [True, False])
def test_euler_tours_over_loops_parallel_edges_and_components(spark, directed):
    draw = random.Random(9)
    edges = []
    for part in (0, 100, 200):
        for _ in range(4):
            walk = [part] + [part + draw.randrange(6) for _ in range(draw.randrange(1, 7))] + [part]
            edges += [(len(edges) + k, u, v) for k, (u, v) in enumerate(zip(walk, walk[1:], strict=False))]
    assert check_tours(spark, edges, directed, True) == 3
    edges += [(len(edges), 0, 5), (len(edges) + 1, 103, 100)]
    assert check_tours(spark, edges, directed, False) == 3
    with pytest.raises(ValueError):
        euler_rounds.euler_rows(spark.createDataFrame(edges, "edge long, src long, dst long"), directed)


def cliques_by_hand(nodes, edges):
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in nodes}
    grown = {frozenset([v]) for v in nodes}
    out = set()
    while grown:
        bigger = {c | {v}: None for c in grown for v in nodes if v not in c and c <= near[v]}
        out |= {c for c in grown if not any(c <= near[v] for v in nodes if v not in c)}
        grown = set(bigger)
    return {tuple(sorted(c)) for c in out}


@pytest.mark.parametrize("nodes, n, share", [(9, 26, 20_000), (14, 60, 1), (12, 130, 2), (6, 0, 1)])
def test_maximal_clique_rows(spark, monkeypatch, nodes, n, share):
    """Dense and sparse graphs, searches shared by several tasks, nodes alone, loops."""
    monkeypatch.setattr(maximal_cliques, "SHARE", share)
    draw = random.Random(n)
    edges = {tuple(sorted(e)): 1 for e in some_edges(draw, nodes, n)} | {(50, 50): 1, (51, 52): 1}
    g = graph_of(edges, False).add_nodes_from_keys([*range(nodes), 60])
    want = cliques_by_hand({*range(nodes), 50, 51, 52, 60}, [e for e in edges if e[0] != e[1]])
    got = [tuple(r["clique"]) for r in maximal_cliques.maximal_clique_rows(g).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_few_neighbours_go_later(spark):
    """A star and a clique: the hub has no later neighbours though all others join it."""
    edges = [(0, i) for i in range(1, 200)] + [(a, b) for a in range(300, 305) for b in range(a + 1, 305)]
    turn = {r["id"]: r["turn"] for r in maximal_cliques.peeled(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(turn) == 205 and turn[0] > turn[1]
    assert [r for r in maximal_cliques.peeled(spark.createDataFrame([], "src long, dst long")).collect()] == []


def test_a_small_file_of_many_rows_is_not_broadcast(spark):
    """A million rows in a file of a few MB were planned as a broadcast, which the driver hashes."""
    from pyspark.sql import functions as F

    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        many = materialize(spark.range(1_000_000).select("id", (F.col("id") % 25).alias("hub")), "many")
        plan = many.join(many.withColumnRenamed("hub", "other"), "id")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "10MB"
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed, rest", [(1, 0), (2, 5)])
def test_contraction(spark, seed, rest):
    """Components, sides and odd cycles by rounds of contraction, with loops, repeats, nulls and ids of any sign."""
    draw = random.Random(seed)
    links = [(draw.randrange(-40, 40), draw.randrange(-40, 40)) for _ in range(45)] + [(1000 + i, 1001 + i) for i in range(30)] + [(7, 7), (500, 500), (None, 3)]
    links += [(2000 + i, 2000 + (i + 1) % 5) for i in range(5)] + [(3000 + i, 3000 + (i + 1) % 6) for i in range(6)]
    near = defaultdict(set)
    for u, v in links:
        if u is not None and v is not None:
            near[u].add(v)
            near[v].add(u)
    want = set()
    for start in sorted(near):
        if any(start == w[0] for w in want):
            continue
        side, todo, odd = {start: 0}, [start], False
        while todo:
            x = todo.pop()
            for y in near[x]:
                if y not in side:
                    side[y] = 1 - side[x]
                    todo.append(y)
                odd |= side[y] == side[x]
        want |= {(x, start, None if odd else s, odd) for x, s in side.items()}
    frame = spark.createDataFrame(links, "a long, b long")
    got = {(r["node"], r["component"], None if r["odd"] else r["side"], r["odd"]) for r in contraction.contracted(frame, "a", "b", True, rest).collect()}
    assert got == want
    plain = {(r["node"], r["component"]) for r in contraction.contracted(frame, "a", "b", rest=rest).collect()}
    assert plain == {w[:2] for w in want}
    assert {tuple(r) for r in contraction.component_links(frame, "a", "b").collect()} == plain


@pytest.mark.parametrize("rest", [0, 8, 1000])
def test_lists_are_ranked_by_contraction(spark, rest):
    draw = random.Random(rest)
    ids = draw.sample(range(-500, 500), 90)
    lists = [ids[:1], ids[1:3], ids[3:6], ids[6:30], ids[30:]]
    links = [(x, y) for part in lists for x, y in zip(part, [*part[1:], None], strict=True)]
    got = {r["at"]: r["d"] for r in ranking.ranked(spark.createDataFrame(links, "at long, next long"), rest).collect()}
    assert got == {x: len(part) - 1 - i for part in lists for i, x in enumerate(part)}


@pytest.mark.parametrize("seed", range(2))
def test_least_cut_by_contraction(spark, seed):
    draw = random.Random(seed)
    edges = {(i, i + 1): draw.randrange(2, 9) for i in range(12)} | {(u, v): w for (u, v), w in some_edges(draw, 13, 14, 1, 9).items() if u < v}
    g = graph_of(edges, False)
    found, want = flow.global_min_cut(g, cut_edges=0), kernels.global_min_cut(Local.of(g))
    assert (found.weight, found.group_a_size + found.group_b_size) == (want[0], 13)
    apart = graph_of(edges | {(50, 51): 1}, False)
    assert flow.global_min_cut(apart, cut_edges=0) == flow.GlobalMinCut(0, 13, 2)


def test_least_cut_of_a_long_path(spark):
    """Ends of edges as heavy as the bound are merged; the kernel alone would take an order a node."""
    held, kernels.global_min_cut = kernels.global_min_cut, None
    try:
        path = materialize(spark.range(3000).selectExpr("id AS src", "id + 1 AS dst", "IF(id = 1234, 2L, 5L) AS w"))
        assert flow.global_min_cut(Graph.from_frames(None, path, False)) == flow.GlobalMinCut(2, 1235, 1766)
    finally:
        kernels.global_min_cut = held


def test_trails_that_meet_nowhere_take_no_forest(spark, monkeypatch):
    """Each component is one closed trail, so nothing is merged."""

    def none(*_):
        raise AssertionError("a forest over all vertices")

    monkeypatch.setattr(euler_rounds, "spanning_forest", none)
    edges = spark.createDataFrame([(10 * c + i, 10 * c + i, 10 * c + (i + 1) % 4) for c in range(3) for i in range(4)], "edge long, src long, dst long")
    for directed in (True, False):
        got = euler_rounds.euler_rows(edges, directed).orderBy("component", "position").collect()
        assert [(r["component"], r["position"]) for r in got] == [(10 * c, i) for c in range(3) for i in range(4)]
        assert all(a["dst"] == b["src"] for a, b in zip(got, got[1:], strict=False) if a["component"] == b["component"])
