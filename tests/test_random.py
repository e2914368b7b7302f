"""Random models against what holds for every draw, and against exact expectations over several seeds."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arcweave.generators import attached, classes, draws, rand
from arcweave.generators.draws import uniform
from arcweave.model import Graph


def edges_of(g):
    return [(r["src"], r["dst"]) for r in g.edges.select("src", "dst").collect()]


def simple(edges):
    return all(a != b for a, b in edges) and len({(min(e), max(e)) for e in edges}) == len(edges)


def near(found, expected):
    return abs(found - expected) <= 5 * math.sqrt(expected) + 3


@pytest.mark.parametrize("total, m", [(1, 1), (10, 10), (10, 7), (1000, 480), (10**12, 300), (7, 0)])
def test_distinct_numbers(spark, total, m):
    got = [r["k"] for r in draws.distinct_numbers(total, m, 3).collect()]
    assert len(got) == len(set(got)) == m and all(0 <= k < total for k in got)


@pytest.mark.parametrize("n", [2, 5, 6, 9])
@pytest.mark.parametrize("directed", [False, True])
def test_gnm_numbers_every_pair_once(spark, n, directed):
    whole = n * (n - 1) // (1 if directed else 2)
    found = edges_of(rand.erdos_renyi_gnm(n, 10**6, 1, directed))
    assert len(set(found)) == len(found) == whole and all(a != b for a, b in found) and (directed or simple(found))


def test_gnm_sets_are_equally_likely(spark):
    seen = Counter(tuple(sorted(edges_of(rand.erdos_renyi_gnm(3, 1, seed)))) for seed in range(24))
    assert len(seen) == 3 and max(seen.values()) < 18


def test_preferential_attachment(spark, monkeypatch):
    monkeypatch.setattr(attached, "CORE", 8)
    found = edges_of(rand.barabasi_albert(400, 3, 5, True))
    assert simple(found) and len(found) == 3 + 397 * 3
    out = Counter(a for a, b in found if a > b)
    assert all(out[u] == 3 for u in range(3, 400)) and all(b < a for a, b in found if a >= 3)
    degree = Counter(x for e in found for x in e)
    assert sum(degree[u] for u in range(20)) > 2 * sum(degree[u] for u in range(200, 220))
    assert set(found) == set(edges_of(rand.barabasi_albert(400, 3, 5, True)))
    assert edges_of(rand.barabasi_albert(2, 2, 1)) == [(0, 1)] and rand.barabasi_albert(1, 2, 1).order() == 0


def test_preferential_attachment_follows_degrees(spark, monkeypatch):
    """The share of node 0 in the choices of late nodes is its share of the edge ends, as in growth one by one."""
    monkeypatch.setattr(attached, "CORE", 4)
    by_rounds = [sum(1 for a, b in edges_of(rand.barabasi_albert(60, 1, s, True)) if b == 0) for s in range(6)]
    one_by_one = [sum(1 for _, b in attached._core(60, 1, s) if b == 0) for s in range(400)]
    mean = sum(one_by_one) / 400
    spread = math.sqrt(sum((x - mean) ** 2 for x in one_by_one) / 400)
    assert abs(sum(by_rounds) / 6 - mean) < 4 * spread / math.sqrt(6)


@pytest.mark.parametrize("n, k, p", [(20, 4, 0.3), (30, 4, 1.0), (12, 2, 0.0), (7, 6, 1.0), (8, 6, 0.9)])
def test_small_world(spark, n, k, p):
    found = edges_of(rand.watts_strogatz(n, k, p, 2))
    assert simple(found) and len(found) == n * k // 2
    ring = {(min(u, v), max(u, v)) for u in range(n) for d in range(1, k // 2 + 1) for v in [(u + d) % n]}
    assert p > 0 or set(found) == ring
    assert p < 1 or n < 20 or len(set(found) & ring) < len(ring) / 2


@pytest.mark.parametrize("degrees", [[3, 3, 2, 2, 2, 2], [1, 1, 1, 3], [2, 2, 2], [5] * 6, [4, 4, 3, 3, 3, 3, 2, 2], [0, 0], []])
def test_configurations_have_their_degrees(spark, degrees):
    found = edges_of(rand.configuration_model(degrees, 4))
    have = Counter(x for e in found for x in e)
    assert simple(found) and [have[u] for u in range(len(degrees))] == degrees


@pytest.mark.parametrize("degrees", [[2, 2], [3, 1], [1, 1, 1], [-1, 1], [4, 4, 4, 1, 1]])
def test_impossible_degrees(spark, degrees):
    with pytest.raises(rand.NoGraph):
        rand.configuration_model(degrees)


def realisable(degrees):
    left = sorted(degrees, reverse=True)
    while left and left[0] > 0:
        d, left = left[0], left[1:]
        if d > len(left) or left[d - 1] == 0:
            return False
        left = sorted([x - 1 for x in left[:d]] + left[d:], reverse=True)
    return True


def test_possible_degrees_as_by_hand(spark):
    draw = random.Random(1)
    for _ in range(25):
        degrees = [draw.randrange(0, 6) for _ in range(draw.randrange(1, 8))]
        if sum(degrees) % 2 == 0:
            rows = spark.createDataFrame(list(enumerate(degrees)), "id long, degree long")
            assert attached._possible(rows, False, False) == realisable(degrees), degrees


def test_multigraph_pairs_keep_degrees(spark):
    rows = spark.createDataFrame([(5, 70_000), (9, 69_998), (11, 2)], "id long, degree long")
    found = attached.paired(rows, 1, True, True)
    ends = {r["id"]: r["n"] for r in found.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert ends == {5: 70_000, 9: 69_998, 11: 2}


def test_randomized_degrees_keep_ids(spark):
    g = Graph.from_edges([(10, 20, 5), (20, 30, 1), (30, 40, 1), (40, 10, 2), (10, 30, 7)], False)
    made = rand.randomize_degree_sequence(g, 3, allow_loops=False, allow_multi=False)
    pick = lambda x: sorted((r["id"], r["degree"]) for r in x.degrees().collect())
    assert pick(made) == pick(g) and {r["w"] for r in made.edges.collect()} == {1}


@pytest.mark.parametrize("theta", ["power_law", "poisson", lambda r: r.choice([0.0, 1.0, 8.0])])
def test_corrected_blocks_have_their_probabilities(spark, theta):
    n, k, p_in, p_out = 120, 3, 0.08, 0.02
    inside = outside = want_in = want_out = 0.0
    for seed in range(3):
        raw = {r["id"]: r["raw"] for r in classes.weights(n, seed, theta, 2.2, 3.0).collect()}
        scale = n / sum(raw.values())
        for u in range(n):
            for v in range(u + 1, n):
                same = u % k == v % k
                p = min(1.0, raw[u] * raw[v] * scale * scale * (p_in if same else p_out))
                want_in, want_out = want_in + p * same, want_out + p * (not same)
        found = edges_of(rand.dcsbm(n, k, p_in, p_out, seed, theta, 2.2, 3.0))
        assert simple(found)
        inside += sum(u % k == v % k for u, v in found)
        outside += sum(u % k != v % k for u, v in found)
    assert near(inside, want_in) and near(outside, want_out)


def test_pairs_of_skewed_weights_are_not_all_listed(spark, monkeypatch):
    """With weights of a power law a few nodes reach probability 1; what is drawn stays near the edges, not all pairs."""
    listed = []
    whole = classes.drawn
    monkeypatch.setattr(classes, "drawn", lambda *a: (lambda df: (listed.append(df.count()), df)[1])(whole(*a)))
    found = rand.dcsbm(3000, 2, 0.002, 0.001, 1).edge_count()
    assert sum(listed) < 5 * found + 2000 < 3000 * 2999 / 20


def test_block_tree_has_its_probabilities(spark):
    n, probabilities = 150, [0.02, 0.1, 0.5]
    found, want = Counter(), Counter()
    level = lambda u, v: 2 if u % 4 == v % 4 else int(u % 4 // 2 == v % 4 // 2)
    for u in range(n):
        for v in range(u + 1, n):
            want[level(u, v)] += 2 * probabilities[level(u, v)]
    for seed in (1, 2):
        edges = edges_of(rand.hsbm(n, 2, 2, probabilities, seed))
        assert simple(edges)
        found.update(level(u, v) for u, v in edges)
    assert all(near(found[i], want[i]) for i in range(3))
    assert rand.hsbm(3, 2, 5, [1.0]).edge_count() == 3


@pytest.mark.parametrize("n, alpha, beta", [(200, 0.05, 0.9), (300, 0.01, 1.0), (150, 0.8, 0.3)])
def test_waxman_has_its_probabilities(spark, n, alpha, beta):
    found = want = 0.0
    for seed in range(3):
        at = {r["id"]: (r["x0"], r["x1"]) for r in rand._positions(n, seed, 2).collect()}
        want += sum(beta * math.exp(-math.dist(at[u], at[v]) / (alpha * math.sqrt(2))) for u in range(n) for v in range(u + 1, n))
        edges = edges_of(rand.waxman(n, alpha, beta, seed))
        assert simple(edges)
        found += len(edges)
    assert near(found, want)


def test_ranges_of_a_group_are_drawn_apart(spark, monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 50)
    groups = spark.createDataFrame([(1, 1000, 1.0), (2, 10_000, 0.1), (3, 0, 0.5), (4, 10, 0.0)], "g long, m long, p double")
    got = draws.drawn(groups, ["g"], 1).select("g", "k").collect()
    assert sorted(r["k"] for r in got if r["g"] == 1) == list(range(1000)) and len(got) == len(set(got))
    assert near(sum(r["g"] == 2 for r in got), 1000) and {r["g"] for r in got} == {1, 2}
    assert spark.range(3).select(uniform(1, F.col("id")).alias("u")).distinct().count() == 3
