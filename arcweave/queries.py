"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave import datasets as ds
from arcweave.builders import grid, labeled
from arcweave.builders.live import apply_log
from arcweave.generators import classic, maze, rand
from arcweave.model import Graph, canonical, edge_frame
from arcweave.operators import (
    approximate, centrality, cliques, connectivity, dag, flow, health, matching, operation, paths, planarity, spanning, structure, transform, traversal,
)
from arcweave.operators.disjoint_set import DisjointSet
from arcweave.operators.multigraph import MultiGraph
from arcweave.sources import text_formats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def one_row(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)


def edges_of(g: Graph) -> DataFrame:
    return g.edges.select("src", "dst", F.col("w").cast("long").alias("w"))


def undirected_flow(spark: SparkSession, sf_dir: str) -> Graph:
    return transform.to_undirected(ds.flow(spark, sf_dir), "sum")


UFLOW = ds.FLOW + ", uflow AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, SUM(w) AS w FROM flow GROUP BY 1, 2)"
UARCS = UFLOW + ", arcs AS (SELECT src, dst, w FROM uflow UNION ALL SELECT dst, src, w FROM uflow)"
#: Integer weights on trade for shortest paths: few sales make a long way.
COST = "CAST(1000000 // w AS BIGINT)"


def trade_cost(spark: SparkSession, sf_dir: str) -> Graph:
    return transform.map_edges(ds.trade(spark, sf_dir), lambda w: F.expr("1000000 div w").cast("long"))


def dag_trade(spark: SparkSession, sf_dir: str) -> Graph:
    return transform.filter_edges(ds.trade(spark, sf_dir), lambda s, d, w: (s < d) & (w % 3 != 0))


DAG = ds.TRADE + ", dag AS (SELECT src, dst, w FROM trade WHERE src < dst AND w % 3 <> 0)"
N = 25

# ---------------------------------------------------------------- centrality


def chained(first: str, step: Callable[[int], str], rounds: int, name: str = "r") -> str:
    return f", {name}0 AS ({first})" + "".join(f", {name}{i} AS ({step(i)})" for i in range(1, rounds + 1))


@query(
    f"WITH {ds.TRADE}, o AS (SELECT src AS id, COUNT(*) AS c FROM trade GROUP BY 1), i AS (SELECT dst AS id, COUNT(*) AS c FROM trade GROUP BY 1) "
    "SELECT n.id, CAST(coalesce(o.c, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.c, 0) AS BIGINT) AS in_degree, "
    "CAST(coalesce(o.c, 0) + coalesce(i.c, 0) AS BIGINT) AS degree FROM nodes n LEFT JOIN o ON n.id = o.id LEFT JOIN i ON n.id = i.id"
)
def degrees_trade(spark, sf_dir):
    return ds.trade(spark, sf_dir).degrees()


@query(
    f"WITH {ds.FLOW}, d AS (SELECT id, COUNT(*) AS c FROM (SELECT src AS id FROM flow UNION ALL SELECT dst FROM flow) GROUP BY 1) "
    "SELECT n.id, round(coalesce(c, 0) / ((SELECT COUNT(*) FROM nodes) - 1.0), 9) AS score FROM nodes n LEFT JOIN d ON n.id = d.id"
)
def degree_centrality_flow(spark, sf_dir):
    return centrality.degree_total(ds.flow(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


RANK_ROUNDS = 12
_RANK = f"WITH {ds.FLOW}, o AS (SELECT src AS id, COUNT(*) AS c FROM flow GROUP BY 1), k AS (SELECT COUNT(*) * 1.0 AS n FROM nodes)" + chained(
    "SELECT id, 1.0 / n AS s FROM nodes, k",
    lambda i: (
        "SELECT n.id, 0.15 / max(k.n) + 0.85 * (coalesce(sum(p.s / o.c), 0) + (SELECT coalesce(sum(s), 0) FROM "
        f"r{i - 1} WHERE id NOT IN (SELECT id FROM o)) / max(k.n)) AS s FROM nodes n CROSS JOIN k LEFT JOIN flow e ON e.dst = n.id "
        f"LEFT JOIN r{i - 1} p ON p.id = e.src LEFT JOIN o ON o.id = e.src GROUP BY n.id"
    ),
    RANK_ROUNDS,
)


@query(_RANK + f" SELECT id, round(s, 8) AS score FROM r{RANK_ROUNDS}")
def pagerank_flow(spark, sf_dir):
    options = centrality.PageRankOptions(0.85, RANK_ROUNDS, 0.0)
    return centrality.pagerank(ds.flow(spark, sf_dir), options).select("id", F.round("score", 8).alias("score"))


@query(_RANK.replace(ds.FLOW, ds.TRADE).replace("flow", "trade") + f" SELECT id, round(s, 8) AS score FROM r{RANK_ROUNDS}")
def pagerank_trade(spark, sf_dir):
    options = centrality.PageRankOptions(0.85, RANK_ROUNDS, 0.0)
    return centrality.pagerank(ds.trade(spark, sf_dir), options).select("id", F.round("score", 8).alias("score"))


def _got(i: int) -> str:
    return f"SELECT n.id, CAST(coalesce(sum(p.s), 0) AS DOUBLE) AS g FROM nodes n LEFT JOIN flow e ON e.dst = n.id LEFT JOIN r{i - 1} p ON p.id = e.src GROUP BY n.id"


@query(
    f"WITH {ds.FLOW}" + chained("SELECT id, CAST(1 AS DOUBLE) AS s FROM nodes", lambda i: f"SELECT id, CAST(0.001 AS DOUBLE) * g + 1.0 AS s FROM ({_got(i)})", 6) + " SELECT id, round(s, 8) AS score FROM r6"
)
def katz_flow(spark, sf_dir):
    return centrality.katz(ds.flow(spark, sf_dir), 0.001, 1.0, 6, 0.0).select("id", F.round("score", 8).alias("score"))


@query(f"WITH {ds.FLOW}" + chained("SELECT id, CAST(1 AS DOUBLE) AS s FROM nodes", lambda i: f"SELECT id, CAST(0.01 AS DOUBLE) * g AS s FROM ({_got(i)})", 4) + " SELECT id, round(s, 8) AS score FROM r4")
def alpha_centrality_flow(spark, sf_dir):
    return centrality.alpha_centrality(ds.flow(spark, sf_dir), 0.01, 1.0, 4, 0.0).select("id", F.round("score", 8).alias("score"))


@query(
    f"WITH {ds.FLOW}" + chained("SELECT id, 1.0 / sqrt((SELECT COUNT(*) FROM nodes)) AS s FROM nodes", lambda i: f"SELECT id, g / sqrt(sum(g * g) OVER ()) AS s FROM ({_got(i)})", 6)
    + " SELECT id, round(s, 8) AS score FROM r6"
)
def eigenvector_flow(spark, sf_dir):
    return centrality.eigenvector(ds.flow(spark, sf_dir), 6, 0.0).select("id", F.round("score", 8).alias("score"))


def _hits(i: int) -> str:
    a = f"SELECT n.id, coalesce(sum(p.h), 0) AS a FROM nodes n LEFT JOIN flow e ON e.dst = n.id LEFT JOIN r{i - 1} p ON p.id = e.src GROUP BY n.id"
    h = f"SELECT n.id, coalesce(sum(x.a), 0) AS h FROM nodes n LEFT JOIN flow e ON e.src = n.id LEFT JOIN ({a}) x ON x.id = e.dst GROUP BY n.id"
    return f"SELECT y.id, h / sqrt(sum(h * h) OVER ()) AS h, a / sqrt(sum(a * a) OVER ()) AS a FROM ({h}) y JOIN ({a}) x ON x.id = y.id"


@query(
    f"WITH {ds.FLOW}" + chained("SELECT id, 1.0 / sqrt((SELECT COUNT(*) FROM nodes)) AS h, 0.0 AS a FROM nodes", _hits, 5)
    + " SELECT id, round(h, 8) AS hub, round(a, 8) AS authority FROM r5"
)
def hits_flow(spark, sf_dir):
    return centrality.hits(ds.flow(spark, sf_dir), 5, 0.0).select("id", F.round("hub", 8).alias("hub"), F.round("authority", 8).alias("authority"))


_APSP = f"WITH {ds.TRADE}, c AS (SELECT src, dst, {COST} AS w FROM trade)" + chained(
    "SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM c UNION ALL SELECT id, id, CAST(0 AS BIGINT) FROM nodes) GROUP BY 1, 2",
    lambda i: f"SELECT a.src, b.dst, min(a.w + b.w) AS w FROM r{i - 1} a JOIN r{i - 1} b ON a.dst = b.src GROUP BY 1, 2",
    5,
)


@query(_APSP + " SELECT src, dst, CAST(w AS BIGINT) AS dist FROM r5")
def all_pairs_trade(spark, sf_dir):
    return paths.all_pairs(trade_cost(spark, sf_dir))


@query(_APSP + " SELECT dst AS id, CAST(w AS BIGINT) AS dist FROM r5 WHERE src = 0")
def single_source_trade(spark, sf_dir):
    return paths.single_source_distances(trade_cost(spark, sf_dir), 0)


@query(_APSP + " SELECT src, dst, CAST(w AS BIGINT) AS dist FROM r5 WHERE src IN (1, 5, 9) AND dst IN (1, 5, 9)")
def distance_matrix_trade(spark, sf_dir):
    return paths.distance_matrix(trade_cost(spark, sf_dir), [1, 5, 9])


@query(_APSP + f" SELECT src AS id, round({N - 1}.0 / sum(w), 12) AS score FROM r5 GROUP BY 1")
def closeness_trade(spark, sf_dir):
    return centrality.closeness(trade_cost(spark, sf_dir)).select("id", F.round("score", 12).alias("score"))


@query(_APSP + f" SELECT src AS id, round(sum(1.0 / w) / {N - 1}, 9) AS score FROM r5 WHERE w > 0 GROUP BY 1")
def harmonic_trade(spark, sf_dir):
    return centrality.harmonic_centrality(trade_cost(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


@query(_APSP + " SELECT src AS id, CAST(max(w) AS DOUBLE) AS ecc FROM r5 GROUP BY 1")
def eccentricity_trade(spark, sf_dir):
    return health.eccentricities(trade_cost(spark, sf_dir))


@query(
    _APSP + f", e AS (SELECT src, max(w) AS m FROM r5 GROUP BY 1) SELECT (SELECT CAST(max(m) AS DOUBLE) FROM e) AS diameter, (SELECT CAST(min(m) AS DOUBLE) FROM e) AS radius, "
    f"round((SELECT sum(w) FROM r5) / ({N}.0 * {N - 1}), 6) AS mean_path, round((SELECT sum(1.0 / w) FROM r5 WHERE w > 0) / ({N}.0 * {N - 1}), 9) AS efficiency"
)
def distances_summary_trade(spark, sf_dir):
    g = trade_cost(spark, sf_dir)
    return one_row(
        spark, diameter=health.diameter(g), radius=health.radius(g), mean_path=round(health.average_path_length(g), 6), efficiency=round(health.global_efficiency(g), 9)
    )


@query(
    f"WITH {ds.TRADE}" + chained(
        "SELECT src, dst, max(w) AS w FROM trade WHERE src <> dst GROUP BY 1, 2",
        lambda i: f"SELECT src, dst, max(w) AS w FROM (SELECT * FROM r{i - 1} UNION ALL SELECT a.src, b.dst, least(a.w, b.w) FROM r{i - 1} a JOIN r{i - 1} b ON a.dst = b.src "
        "WHERE a.src <> b.dst) GROUP BY 1, 2", 5,
    ) + " SELECT dst AS id, CAST(w AS BIGINT) AS dist FROM r5 WHERE src = 0"
)
def widest_paths_trade(spark, sf_dir):
    return paths.widest_distances(ds.trade(spark, sf_dir), 0).select("id", F.col("dist").cast("long").alias("dist"))


@query(
    f"WITH {ds.FLOW}, k AS (SELECT src, COUNT(*) AS k FROM flow GROUP BY 1), p AS (SELECT a.k * 1.0 AS x, coalesce(b.k, 0) * 1.0 AS y FROM flow JOIN k a ON a.src = flow.src "
    "LEFT JOIN k b ON b.src = flow.dst), m AS (SELECT avg(x * y) AS xy, avg((x + y) / 2) AS m, avg((x * x + y * y) / 2) AS q FROM p) "
    "SELECT round((xy - m * m) / (q - m * m), 6) AS score FROM m"
)
def assortativity_flow(spark, sf_dir):
    return one_row(spark, score=round(health.assortativity(ds.flow(spark, sf_dir)), 6))


#: Hops of at most 8 by doubling, counts of shortest paths a level at a time.
_HOPS = f"""WITH {ds.FLOW},
h1 AS (SELECT src AS s, dst AS t, 1 AS d FROM flow UNION ALL SELECT id, id, 0 FROM nodes),""" + "".join(f"""
h{2 * k} AS (SELECT a.s, b.t, min(a.d + b.d) AS d FROM h{k} a JOIN h{k} b ON a.t = b.s GROUP BY 1, 2),""" for k in (1, 2, 4)) + """
c0 AS (SELECT id AS s, id AS t, 1.0::DOUBLE AS c FROM nodes)""" + "".join(f""",
c{k} AS (SELECT c.s, f.dst AS t, sum(c.c) AS c FROM c{k - 1} c JOIN flow f ON f.src = c.t JOIN h8 h ON h.s = c.s AND h.t = f.dst AND h.d = {k} GROUP BY 1, 2)""" for k in range(1, 9)) + """,
n AS (SELECT s, t, d, c FROM h8 JOIN (""" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(9)) + ") USING (s, t))"  # fmt: skip


@query(_HOPS + """, b AS (SELECT x.t AS id, sum(x.c * y.c / z.c) AS score FROM n x JOIN n y ON x.t = y.s JOIN n z ON z.s = x.s AND z.t = y.t
  WHERE x.d > 0 AND y.d > 0 AND x.s <> y.t AND x.d + y.d = z.d GROUP BY 1)
SELECT id, round(coalesce(score, 0.0), 6) AS score FROM nodes LEFT JOIN b USING (id)""")
def betweenness_flow(spark, sf_dir):
    return centrality.betweenness(ds.flow(spark, sf_dir), weighted=False).select("id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- transforms and algebra


@query(f"WITH {ds.TRADE} SELECT dst AS src, src AS dst, w FROM trade")
def transpose_trade(spark, sf_dir):
    return edges_of(transform.transpose(ds.trade(spark, sf_dir)))


@query(f"WITH {ds.TRADE} SELECT id, upper(data) || '!' AS data FROM nodes")
def map_nodes_trade(spark, sf_dir):
    return transform.map_nodes(ds.trade(spark, sf_dir), lambda d: F.concat(F.upper(d), F.lit("!"))).nodes


@query(f"WITH {ds.TRADE} SELECT src, dst, CAST(w * 2 + src AS BIGINT) AS w FROM trade")
def map_edges_trade(spark, sf_dir):
    return edges_of(transform.map_edges_indexed(ds.trade(spark, sf_dir), lambda s, d, w: w * 2 + s))


@query(
    f"WITH {ds.TRADE}, k AS (SELECT id FROM nodes WHERE regexp_matches(data, '[02468]$')) SELECT src, dst, w FROM trade WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"
)
def filter_nodes_trade(spark, sf_dir):
    return edges_of(transform.filter_nodes(ds.trade(spark, sf_dir), lambda d: d.rlike("[02468]$")))


@query(f"WITH {ds.TRADE} SELECT src, dst, w FROM trade WHERE w % 2 = 0 AND src <> dst")
def filter_edges_trade(spark, sf_dir):
    return edges_of(transform.filter_edges(ds.trade(spark, sf_dir), lambda s, d, w: (w % 2 == 0) & (s != d)))


@query(
    f"WITH {DAG} SELECT a.id AS src, b.id AS dst, CAST(1 AS BIGINT) AS w FROM nodes a JOIN nodes b ON a.id <> b.id "
    "WHERE NOT EXISTS (SELECT 1 FROM dag WHERE dag.src = a.id AND dag.dst = b.id)"
)
def complement_trade(spark, sf_dir):
    return edges_of(transform.complement(dag_trade(spark, sf_dir)))


@query(f"WITH {ds.TRADE} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(SUM(w) AS BIGINT) AS w FROM trade GROUP BY 1, 2")
def to_undirected_trade(spark, sf_dir):
    return edges_of(transform.to_undirected(ds.trade(spark, sf_dir), "sum"))


@query(
    f"WITH {ds.TRADE}, m AS (SELECT CASE WHEN src = 2 THEN 1 ELSE src END AS src, CASE WHEN dst = 2 THEN 1 ELSE dst END AS dst, w FROM trade "
    "WHERE NOT ((src = 1 AND dst = 2) OR (src = 2 AND dst IN (1, 2)))) SELECT src, dst, CAST(SUM(w) AS BIGINT) AS w FROM m GROUP BY 1, 2"
)
def contract_trade(spark, sf_dir):
    return edges_of(transform.contract(ds.trade(spark, sf_dir), 1, 2))


@query(
    f"WITH {ds.TRADE}, b AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS r FROM nation) "
    "SELECT x.r AS src, y.r AS dst, CAST(SUM(w) AS BIGINT) AS w FROM trade JOIN b x ON src = x.id JOIN b y ON dst = y.id WHERE x.r <> y.r GROUP BY 1, 2"
)
def quotient_trade(spark, sf_dir):
    blocks = ds.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("block"))
    return edges_of(transform.quotient_graph(ds.trade(spark, sf_dir), blocks, "sum", "min"))


@query(
    f"WITH {ds.FLOW}, ranked AS (SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS n FROM nodes) "
    "SELECT a.n AS src, b.n AS dst, w FROM flow JOIN ranked a ON src = a.id JOIN ranked b ON dst = b.id"
)
def normalize_ids_flow(spark, sf_dir):
    return edges_of(transform.normalize_node_ids(ds.flow(spark, sf_dir)))


@query(
    f"WITH {DAG}, near AS (SELECT CAST(3 AS BIGINT) AS id UNION SELECT dst FROM dag WHERE src = 3 UNION SELECT b.dst FROM dag a JOIN dag b ON a.dst = b.src WHERE a.src = 3) "
    "SELECT src, dst, w FROM dag WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)"
)
def ego_graph_trade(spark, sf_dir):
    return edges_of(transform.ego_graph(dag_trade(spark, sf_dir), 3, 2))


_CLOSURE = f"WITH RECURSIVE {DAG}, reach AS (SELECT src, dst FROM dag UNION SELECT reach.src, dag.dst FROM reach JOIN dag ON reach.dst = dag.src)"


@query(
    f"WITH {DAG}" + chained(
        "SELECT src, dst, w FROM dag", lambda i: f"SELECT src, dst, min(w) AS w FROM (SELECT * FROM r{i - 1} UNION ALL SELECT a.src, b.dst, a.w + b.w FROM r{i - 1} a "
        f"JOIN r{i - 1} b ON a.dst = b.src) GROUP BY 1, 2", 5,
    ) + " SELECT src, dst, CAST(w AS BIGINT) AS w FROM r5"
)
def transitive_closure_trade(spark, sf_dir):
    return edges_of(transform.transitive_closure(dag_trade(spark, sf_dir)))


@query(
    _CLOSURE + " SELECT src, dst, w FROM dag a WHERE NOT EXISTS (SELECT 1 FROM dag b JOIN reach r ON b.dst = r.src WHERE b.src = a.src AND b.dst <> a.dst AND r.dst = a.dst)"
)
def transitive_reduction_trade(spark, sf_dir):
    return edges_of(transform.transitive_reduction(dag_trade(spark, sf_dir)))


@query(
    _CLOSURE + " SELECT n.id, CAST(coalesce(c, 0) AS BIGINT) AS n FROM nodes n LEFT JOIN (SELECT src, COUNT(*) AS c FROM reach GROUP BY 1) r ON n.id = r.src"
)
def reachability_counts_trade(spark, sf_dir):
    return connectivity.reachability_counts(dag_trade(spark, sf_dir))


@query(f"WITH {DAG} SELECT src, dst, w FROM dag WHERE NOT EXISTS (SELECT 1 FROM trade t WHERE t.src = dag.src AND t.dst = dag.dst AND t.w % 2 = 0) "
       "UNION ALL SELECT src, dst, w FROM trade WHERE w % 2 = 0")  # fmt: skip
def union_trade(spark, sf_dir):
    even = transform.filter_edges(ds.trade(spark, sf_dir), lambda s, d, w: w % 2 == 0)
    return edges_of(operation.union(dag_trade(spark, sf_dir), even))


@query(f"WITH {DAG} SELECT src, dst, w FROM dag WHERE w % 2 = 0")
def intersection_trade(spark, sf_dir):
    even = transform.filter_edges(ds.trade(spark, sf_dir), lambda s, d, w: w % 2 == 0)
    return edges_of(operation.intersection(dag_trade(spark, sf_dir), even))


@query(f"WITH {ds.TRADE} SELECT src, dst, w FROM trade WHERE src >= 10 AND dst >= 10")
def difference_trade(spark, sf_dir):
    g = ds.trade(spark, sf_dir)
    low = transform.induced(g, g.nodes.where("id < 10"))
    return edges_of(operation.difference(g, low))


@query(f"WITH {ds.TRADE} SELECT src, dst, w FROM trade WHERE src < 5 AND dst < 5 UNION ALL SELECT src, dst, w FROM trade WHERE src >= 15 AND dst >= 15")
def symmetric_difference_trade(spark, sf_dir):
    g = ds.trade(spark, sf_dir)
    a, b = transform.induced(g, g.nodes.where("id < 15")), transform.induced(g, g.nodes.where("id >= 5"))
    return edges_of(operation.symmetric_difference(a, b))


@query(f"WITH {DAG} SELECT src, dst, w FROM dag UNION ALL SELECT src + {N}, dst + {N}, w FROM dag")
def disjoint_union_trade(spark, sf_dir):
    g = dag_trade(spark, sf_dir)
    return edges_of(operation.disjoint_union(g, g))


_REGION = (
    f"WITH {DAG}, cyc AS (SELECT CAST(r_regionkey AS BIGINT) AS src, CAST((r_regionkey + 1) % 5 AS BIGINT) AS dst FROM region)"
)


def _region_ring(spark, sf_dir) -> Graph:
    region = ds.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("data"))
    edges = region.select(F.col("id").alias("src"), ((F.col("id") + 1) % 5).alias("dst"), F.lit(1).cast("long").alias("w"))
    return Graph(region, edges, True)


@query(
    _REGION + " SELECT n.id * 5 + c.src AS src, n.id * 5 + c.dst AS dst FROM nodes n CROSS JOIN cyc c "
    "UNION ALL SELECT d.src * 5 + r.src, d.dst * 5 + r.src FROM dag d CROSS JOIN cyc r"
)
def cartesian_product_trade(spark, sf_dir):
    return operation.cartesian_product(dag_trade(spark, sf_dir), _region_ring(spark, sf_dir)).edges.select("src", "dst")


@query(_REGION + " SELECT d.src * 5 + c.src AS src, d.dst * 5 + c.dst AS dst FROM dag d CROSS JOIN cyc c")
def tensor_product_trade(spark, sf_dir):
    return operation.tensor_product(dag_trade(spark, sf_dir), _region_ring(spark, sf_dir)).edges.select("src", "dst")


@query(f"WITH {DAG}, e AS (SELECT src, dst, CAST((src + dst) * (src + dst + 1) // 2 + dst AS BIGINT) AS id FROM dag) SELECT a.id AS src, b.id AS dst FROM e a JOIN e b ON a.dst = b.src")
def line_graph_trade(spark, sf_dir):
    return operation.line_graph(dag_trade(spark, sf_dir)).edges.select("src", "dst")


@query(f"WITH {DAG}, p AS (SELECT src, dst FROM dag UNION SELECT a.src, b.dst FROM dag a JOIN dag b ON a.dst = b.src) SELECT src, dst FROM p WHERE src <> dst")
def power_trade(spark, sf_dir):
    return operation.power(dag_trade(spark, sf_dir), 2).edges.select("src", "dst")


# ---------------------------------------------------------------- multigraphs


_LINES = "ln AS (SELECT l_orderkey * 10 + l_linenumber AS eid, l_suppkey AS src, l_partkey AS dst, CAST(l_quantity AS BIGINT) AS w FROM lineitem)"


def _lines(spark, sf_dir) -> MultiGraph:
    rows = ds.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("eid"), F.col("l_suppkey").alias("src"), (F.col("l_partkey")).alias("dst"), F.col("l_quantity").cast("long").alias("w")
    )
    nodes = rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("data", F.lit(None).cast("string"))
    return MultiGraph(nodes, rows, True)


@query(f"WITH {_LINES} SELECT src, dst, CAST(SUM(w) AS BIGINT) AS w FROM ln GROUP BY 1, 2")
def multigraph_sum(spark, sf_dir):
    return edges_of(_lines(spark, sf_dir).to_simple_graph_sum_edges())


@query(f"WITH {_LINES} SELECT src, dst, MIN(w) AS w FROM ln GROUP BY 1, 2")
def multigraph_min(spark, sf_dir):
    return edges_of(_lines(spark, sf_dir).to_simple_graph_min_edges())


@query(f"WITH {_LINES} SELECT src, dst, arg_min(w, eid) AS w FROM ln GROUP BY 1, 2")
def multigraph_first(spark, sf_dir):
    return edges_of(_lines(spark, sf_dir).to_simple_graph())


# ---------------------------------------------------------------- traversal, DAGs, connectivity


@query(
    f"WITH RECURSIVE {DAG}, walk AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS depth UNION SELECT dag.dst, walk.depth + 1 FROM walk JOIN dag ON walk.id = dag.src WHERE walk.depth < 30) "
    "SELECT id, CAST(MIN(depth) AS INT) AS depth FROM walk GROUP BY 1"
)
def bfs_levels_trade(spark, sf_dir):
    return traversal.bfs_levels(dag_trade(spark, sf_dir), 0).select("id", "depth")


@query(f"WITH {ds.CHAIN} SELECT o_orderkey AS id, CAST(rn - 1 AS INT) AS generation FROM placed")
def topological_generations_orders(spark, sf_dir):
    return dag.topological_generations(dag.Dag.from_graph(ds.order_chain(spark, sf_dir)))


@query(f"WITH {ds.CHAIN} SELECT o_orderkey AS id, CAST(coalesce(SUM(w) OVER (PARTITION BY o_custkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dist FROM placed")
def longest_distances_orders(spark, sf_dir):
    return dag.longest_distances(dag.Dag.from_graph(ds.order_chain(spark, sf_dir)))


@query(f"WITH {ds.CHAIN} SELECT o_orderkey AS id FROM placed WHERE rn = 1")
def dag_sources_orders(spark, sf_dir):
    return dag.sources(dag.Dag.from_graph(ds.order_chain(spark, sf_dir)))


@query(
    f"WITH {DAG}" + chained("SELECT id, CASE WHEN id = 0 THEN 1 ELSE 0 END AS n FROM nodes", lambda i: (
        f"SELECT n.id, CASE WHEN n.id = {i} THEN coalesce((SELECT SUM(p.n) FROM dag d JOIN r{i - 1} p ON p.id = d.src WHERE d.dst = {i}), 0) ELSE max(q.n) END AS n "
        f"FROM nodes n JOIN r{i - 1} q ON q.id = n.id GROUP BY n.id"), N - 1)
    + f" SELECT id, CAST(n AS BIGINT) AS n FROM r{N - 1} WHERE n > 0"
)
def path_counts_trade(spark, sf_dir):
    return dag.path_counts(dag.Dag.from_graph(dag_trade(spark, sf_dir)), 0).select("id", F.col("n").cast("long").alias("n"))


@query(f"WITH {ds.CHAIN} SELECT o_orderkey AS id, MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM placed")
def weak_components_orders(spark, sf_dir):
    return connectivity.weakly_connected_components(ds.order_chain(spark, sf_dir))


@query(f"WITH {ds.CHAIN} SELECT MIN(o_orderkey) AS comp, CAST(COUNT(*) AS BIGINT) AS size FROM placed GROUP BY o_custkey HAVING COUNT(*) > 1")
def disjoint_sets_orders(spark, sf_dir):
    pairs = ds.order_chain(spark, sf_dir).edges.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return DisjointSet.from_pairs(pairs).to_lists().select("comp", F.size("members").cast("long").alias("size"))


@query(
    f"WITH RECURSIVE {ds.FLOW}, reach AS (SELECT src, dst FROM flow UNION SELECT reach.src, flow.dst FROM reach JOIN flow ON reach.dst = flow.src) "
    "SELECT n.id, least(n.id, coalesce(MIN(a.dst), n.id)) AS component FROM nodes n LEFT JOIN reach a ON a.src = n.id "
    "AND EXISTS (SELECT 1 FROM reach b WHERE b.src = a.dst AND b.dst = n.id) GROUP BY n.id"
)
def strong_components_flow(spark, sf_dir):
    return connectivity.strongly_connected_components(ds.flow(spark, sf_dir))


@query()
def core_numbers_sold(spark, sf_dir):
    return connectivity.core_numbers(ds.supp_part(spark, sf_dir))


@query("SELECT c_custkey AS a, s_suppkey AS b, CASE WHEN c_nationkey = s_nationkey THEN CAST(c_nationkey AS BIGINT) + 1000 WHEN x.n_regionkey = y.n_regionkey "
       "THEN CAST(x.n_regionkey AS BIGINT) + 1 ELSE 0 END AS lca, CAST(CASE WHEN c_nationkey = s_nationkey THEN 2 WHEN x.n_regionkey = y.n_regionkey THEN 4 ELSE 6 END AS BIGINT) AS distance "
       "FROM customer JOIN supplier ON c_custkey = s_suppkey JOIN nation x ON x.n_nationkey = c_nationkey JOIN nation y ON y.n_nationkey = s_nationkey")  # fmt: skip
def lca_geo(spark, sf_dir):
    state = paths.lca_preprocess(ds.geo_tree(spark, sf_dir), 0)
    c, s = ds.table(spark, sf_dir, "customer"), ds.table(spark, sf_dir, "supplier")
    pairs = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select((F.col("c_custkey") + ds.CUSTOMER).alias("a"), (F.col("s_suppkey") + ds.SUPPLIER).alias("b"))
    found = paths.lca_pairs(state, pairs)
    return found.select((F.col("a") - ds.CUSTOMER).alias("a"), (F.col("b") - ds.SUPPLIER).alias("b"), "lca", F.col("distance").cast("long").alias("distance"))


@query("SELECT true AS arborescence, true AS branching, false AS strong, true AS weak, CAST(0 AS BIGINT) AS root")
def structure_geo(spark, sf_dir):
    g = ds.geo_tree(spark, sf_dir)
    return one_row(
        spark, arborescence=structure.is_arborescence(g), branching=structure.is_branching(g), strong=structure.is_strongly_connected(g),
        weak=structure.is_weakly_connected(g), root=structure.arborescence_root(g),
    )


# ---------------------------------------------------------------- trees, flows, matchings, cliques


_MST = f"WITH {ds.TRADE}, u AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, SUM(w) AS w FROM trade WHERE src <> dst GROUP BY 1, 2), " \
       "k AS (SELECT src, dst, w, ROW_NUMBER() OVER (ORDER BY w, src, dst) AS rk FROM u), a AS (SELECT src, dst, rk FROM k UNION ALL SELECT dst, src, rk FROM k)" + chained(
    "SELECT src, dst, rk FROM a", lambda i: f"SELECT src, dst, min(rk) AS rk FROM (SELECT * FROM r{i - 1} UNION ALL SELECT x.src, y.dst, greatest(x.rk, y.rk) "
    f"FROM r{i - 1} x JOIN r{i - 1} y ON x.dst = y.src WHERE x.src <> y.dst) GROUP BY 1, 2", 5)  # fmt: skip


@query(_MST + " SELECT k.src, k.dst, CAST(k.w AS BIGINT) AS w FROM k JOIN r5 ON r5.src = k.src AND r5.dst = k.dst AND r5.rk = k.rk")
def spanning_forest_trade(spark, sf_dir):
    g = transform.to_undirected(transform.remove_self_loops(ds.trade(spark, sf_dir)), "sum")
    return spanning.spanning_forest(g).select("src", "dst", F.col("w").cast("long").alias("w"))


@query(_MST + " SELECT CAST(SUM(k.w) AS BIGINT) AS total, CAST(COUNT(*) AS BIGINT) AS edges FROM k JOIN r5 ON r5.src = k.src AND r5.dst = k.dst AND r5.rk = k.rk")
def kruskal_trade(spark, sf_dir):
    r = spanning.kruskal(transform.to_undirected(transform.remove_self_loops(ds.trade(spark, sf_dir)), "sum"))
    return one_row(spark, total=int(r.total_weight), edges=r.edge_count)


@query()
def max_flow_trade(spark, sf_dir):
    g = ds.trade(spark, sf_dir)
    r = flow.max_flow(g, 0, 1)
    return one_row(spark, flow=int(r.max_flow), source_side=len(flow.min_cut(r).source_side))


@query(f"WITH {ds.SOLD} SELECT DISTINCT src AS id, CAST(0 AS INT) AS side FROM sold UNION ALL SELECT DISTINCT dst, CAST(1 AS INT) FROM sold")
def bipartite_sold(spark, sf_dir):
    return matching.partition(ds.supp_part(spark, sf_dir)).select("id", F.col("side").cast("int").alias("side"))


@query(f"WITH {ds.SOLD} SELECT CAST(COUNT(DISTINCT src) AS BIGINT) AS pairs FROM sold")
def matching_sold(spark, sf_dir):
    return matching.matching_by_component(ds.supp_part(spark, sf_dir)).agg(F.count("*").alias("pairs"))


@query(f"WITH {UFLOW} SELECT CAST(COUNT(*) AS BIGINT) AS triangles FROM uflow a JOIN uflow b ON a.dst = b.src JOIN uflow c ON c.src = a.src AND c.dst = b.dst")
def triangles_flow(spark, sf_dir):
    return cliques.triangles(undirected_flow(spark, sf_dir)).agg(F.count("*").alias("triangles"))


@query(
    f"WITH {UFLOW}, d AS (SELECT id, COUNT(*) AS k FROM (SELECT src AS id FROM uflow UNION ALL SELECT dst FROM uflow) GROUP BY 1) SELECT round(3.0 * (SELECT COUNT(*) FROM uflow a "
    "JOIN uflow b ON a.dst = b.src JOIN uflow c ON c.src = a.src AND c.dst = b.dst) / (SELECT SUM(k * (k - 1) / 2) FROM d), 9) AS transitivity"
)
def transitivity_flow(spark, sf_dir):
    return one_row(spark, transitivity=round(float(approximate.transitivity_exact(undirected_flow(spark, sf_dir))), 9))


@query("SELECT CAST(COUNT(*) AS BIGINT) AS nodes, CAST(0 AS BIGINT) AS conflicts FROM orders")
def color_parallel_orders(spark, sf_dir):
    g = transform.to_undirected(ds.order_chain(spark, sf_dir))
    color = cliques.color_parallel(g)
    s, d = color.select(F.col("id").alias("src"), F.col("color").alias("a")), color.select(F.col("id").alias("dst"), F.col("color").alias("b"))
    return one_row(spark, nodes=color.count(), conflicts=g.edges.join(s, "src").join(d, "dst").where("a = b").count())


@query("SELECT CAST(0 AS BIGINT) AS uncovered")
def vertex_cover_flow(spark, sf_dir):
    g = undirected_flow(spark, sf_dir)
    cover = approximate.vertex_cover_parallel(g)
    left = g.edges.join(cover.withColumnRenamed("id", "src"), "src", "left_anti").join(cover.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left.agg(F.count("*").alias("uncovered"))


@query(
    f"WITH {UARCS}, d AS (SELECT src AS id, COUNT(*) AS k FROM arcs GROUP BY 1)" + chained(
        "SELECT n.id, CAST(coalesce(k, 0) AS VARCHAR) AS label FROM nodes n LEFT JOIN d ON d.id = n.id",
        lambda i: f"SELECT p.id, md5(p.label || '|' || coalesce((SELECT string_agg(q.label, ',' ORDER BY q.label) FROM arcs a JOIN r{i - 1} q ON q.id = a.dst WHERE a.src = p.id), '')) AS label FROM r{i - 1} p", 2,
    ) + " SELECT id, label FROM r2"
)
def wl_labels_flow(spark, sf_dir):
    return planarity.wl_labels(undirected_flow(spark, sf_dir), 2)


@query()
def random_walks_flow(spark, sf_dir):
    g = ds.flow(spark, sf_dir)
    return traversal.random_walks(g, g.nodes.select("id"), 5, 7)


# ---------------------------------------------------------------- builders, formats, generators


@query(
    "WITH l AS (SELECT n_name AS a, r_name AS b, CAST(n_nationkey AS BIGINT) AS w FROM nation JOIN region ON n_regionkey = r_regionkey), "
    "ids AS (SELECT x, ROW_NUMBER() OVER (ORDER BY x) - 1 AS id FROM (SELECT a AS x FROM l UNION SELECT b FROM l)) "
    "SELECT s.id AS src, d.id AS dst, w FROM l JOIN ids s ON s.x = a JOIN ids d ON d.x = b"
)
def labeled_nations(spark, sf_dir):
    n, r = ds.table(spark, sf_dir, "nation"), ds.table(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("from_label"), F.col("r_name").alias("to_label"), F.col("n_nationkey").cast("long").alias("w"))
    return edges_of(labeled.from_labeled_frame(rows))


@query(
    "WITH e AS (SELECT event_id, user_id AS src, user_id + 1 AS dst, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) "
    "SELECT src, dst, event_id AS w FROM e WHERE rn = 1 AND event_id % 5 <> 0"
)
def live_log_events(spark, sf_dir):
    e = ds.table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 5 == 0, "remove_edge").otherwise("add_edge")
    log = e.select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("src"), (F.col("user_id") + 1).alias("dst"), F.lit(None).cast("string").alias("label"), F.col("event_id").alias("w")
    )
    return edges_of(apply_log(Graph.empty(True), log))


@query("SELECT l_suppkey AS src, l_partkey AS dst, CAST(COUNT(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2")
def scan_edge_list_lines(spark, sf_dir):
    line = ds.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    text = line.select(F.concat_ws("\t", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.concat(F.col("n").cast("string"), F.lit(" # lines"))).alias("value"))
    return text_formats.scan_edge_list(text).edges


@query("SELECT a.i AS src, CAST(a.i + 1 AS BIGINT) AS dst FROM range(600) a(i) WHERE a.i % 30 < 29 UNION ALL SELECT a.i, CAST(a.i + 30 AS BIGINT) FROM range(570) a(i)")
def grid_2d(spark, sf_dir):
    return classic.grid_2d(20, 30).edges.select("src", "dst")


@query("SELECT a.i AS src, b.i AS dst FROM range(64) a(i) JOIN range(64) b(i) ON a.i < b.i AND bit_count(xor(a.i, b.i)) = 1")
def hypercube(spark, sf_dir):
    return classic.hypercube(6).edges.select("src", "dst")


@query("SELECT CAST((i - 1) // 3 AS BIGINT) AS src, i AS dst FROM range(1, 121) t(i)")
def kary_tree(spark, sf_dir):
    return classic.kary_tree(3, 4).edges.select("src", "dst")


@query("SELECT a.i AS src, b.i AS dst FROM range(40) a(i) JOIN range(40) b(i) ON a.i < b.i AND a.i % 3 <> b.i % 3")
def turan(spark, sf_dir):
    return classic.turan(40, 3).edges.select("src", "dst")


@query("SELECT CAST(99 AS BIGINT) AS edges, true AS tree, CAST(100 AS BIGINT) AS nodes")
def maze_wilson(spark, sf_dir):
    g = maze.wilson(10, 10, 3)
    return one_row(spark, edges=g.edge_count(), tree=structure.is_tree(g), nodes=g.order())


@query()
def random_gnp(spark, sf_dir):
    return rand.erdos_renyi_gnp(200, 0.05, 11).edges.select("src", "dst")


@query("WITH c AS (SELECT i AS id, CASE WHEN i % 7 = 3 THEN 1 ELSE 0 END AS wall FROM range(400) t(i)), m AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(a, b)) "
       "SELECT c.id AS src, d.id AS dst FROM c CROSS JOIN m JOIN c d ON d.id = ((c.id // 20 + a + 20) % 20) * 20 + (c.id % 20 + b + 20) % 20 WHERE c.wall = 0 AND d.wall = 0")  # fmt: skip
def toroidal_walk(spark, sf_dir):
    cells = spark.range(400).select("id", F.when(F.col("id") % 7 == 3, 1).otherwise(0).alias("data"))
    return grid.from_cells(cells, 20, 20, grid.rook, grid.avoiding(1), True, True).to_graph().edges.select("src", "dst")


@query("SELECT CAST(3 AS BIGINT) AS isolated")
def edge_ends(spark, sf_dir):
    g = Graph.from_frames(spark.range(5).select("id", F.lit(None).cast("string").alias("data")), canonical(edge_frame([(1, 0, 1)]), False), False)
    return g.degrees().where("degree = 0").agg(F.count("*").alias("isolated"))


from arcweave import queries_extra, queries_more, queries_random, queries_rounds  # noqa: E402, F401  register more
