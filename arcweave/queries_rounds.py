"""Queries of operators that go by rounds over graphs that grow with the tables: paths, flows, matchings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave import datasets as ds
from arcweave.functions.semirings import MAX_MIN, MIN_PLUS
from arcweave.model import Graph, dense_ids
from arcweave.operators import blocks, matching_rounds, path_tables
from arcweave.operators.euler_rounds import euler_path_rows, euler_rows
from arcweave.operators.flow_rounds import max_flow_rows
from arcweave.operators.matching import matching_rows
from arcweave.operators.maximal_cliques import maximal_clique_rows
from arcweave.plans.materialize import materialize
from arcweave.queries import one_row
from arcweave.queries_extra import register
from arcweave.queries_more import RINGS, on_rings, rings

# ---- paths as rows

_HUBS = f"id >= {ds.PART}"


def ring_paths(spark, sf_dir):
    """Every order's shortest path from its nation's hub, a row a node."""
    g = rings(spark, sf_dir)
    trees = materialize(path_tables.best_trees(g, g.nodes.where(_HUBS).select("id")), "trees")
    return path_tables.path_rows(trees).select("src", "dst", "position", "node", "dist")


register(
    "path_rows_rings", f"""WITH {RINGS},
    spot AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM placed),
    goals AS (SELECT hub AS src, o_orderkey AS dst, o_custkey, k AS goal, n, ring AND n - k + 2 < k AS back FROM spot),
    steps AS (
      SELECT src, dst, k AS position, o_orderkey AS node FROM goals JOIN spot USING (o_custkey) WHERE NOT back AND k <= goal
      UNION ALL SELECT src, dst, CASE WHEN k = 1 THEN 1 ELSE spot.n - k + 2 END, o_orderkey FROM goals JOIN spot USING (o_custkey) WHERE back AND (k = 1 OR k >= goal)
      UNION ALL SELECT src, dst, 0, src FROM goals
      UNION ALL SELECT DISTINCT hub, hub, 0, hub FROM spot)
    SELECT src, dst, CAST(position AS BIGINT) AS position, node, CAST(position AS BIGINT) AS dist FROM steps""", ring_paths,
)


def priced_rings(spark, sf_dir) -> Graph:
    """``rings`` with each edge as heavy as the dearer of its orders, in whole units."""
    price = ds.table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("p"))
    g = rings(spark, sf_dir)
    priced = g.edges.select("src", "dst").join(price.select(F.col("o_orderkey").alias("src"), F.col("p").alias("a")), "src", "left")
    priced = priced.join(price.select(F.col("o_orderkey").alias("dst"), F.col("p").alias("b")), "dst", "left")
    return g.with_edges(materialize(priced.select("src", "dst", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).cast("long").alias("w")), "priced"))


#: Distance to each order forward along its customer's orders, and for rings backward over the closing edge.
_PRICED = f"""{RINGS},
price AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders),
spot AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prior,
  MAX(o_orderkey) OVER (PARTITION BY o_custkey) AS final FROM placed),
e AS (SELECT spot.*, a.p AS own, f.p AS fp, greatest(a.p, coalesce(b.p, 0)) AS step, greatest(f.p, z.p) AS closing
  FROM spot JOIN price a ON a.id = o_orderkey JOIN price f ON f.id = first JOIN price z ON z.id = final LEFT JOIN price b ON b.id = prior)"""


def ring_lengths(spark, sf_dir):
    """Length, hops and an own sum over the rows of each order's shortest path by price."""
    g = priced_rings(spark, sf_dir)
    trees = materialize(path_tables.best_trees(g, g.nodes.where(_HUBS).select("id"), MIN_PLUS), "trees")
    rows = path_tables.path_rows(trees)
    steps = rows.withColumn("before", F.lag("node").over(Window.partitionBy("src", "dst").orderBy("position")))
    both = g.edges.select(F.col("src").alias("before"), F.col("dst").alias("node"), "w").union(g.edges.select("dst", "src", "w"))
    walked = steps.join(both, ["before", "node"]).groupBy("src", "dst").agg(F.sum("w").alias("walked"), F.count("*").alias("hops"))
    return trees.join(walked, ["src", "dst"]).select("src", "dst", "dist", walked["hops"].alias("hops"), "walked")


register(
    "path_lengths_priced", f"""WITH {_PRICED},
    d AS (SELECT hub, o_orderkey, ring, n, k, fp, closing, SUM(CASE WHEN k > 1 THEN step ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY k) AS ahead,
      SUM(CASE WHEN k > 1 THEN step ELSE 0 END) OVER (PARTITION BY o_custkey) AS total FROM e),
    b AS (SELECT hub, o_orderkey, fp + ahead AS fore, CASE WHEN ring AND k > 1 THEN fp + closing + total - ahead END AS back, k AS forehops, n - k + 2 AS backhops FROM d)
    SELECT hub AS src, o_orderkey AS dst, CAST(least(fore, coalesce(back, fore)) AS BIGINT) AS dist,
      CAST(CASE WHEN back < fore OR back = fore AND backhops < forehops THEN backhops ELSE forehops END AS BIGINT) AS hops, CAST(least(fore, coalesce(back, fore)) AS BIGINT) AS walked FROM b""",
    ring_lengths,
)


def ring_widths(spark, sf_dir):
    """Width of each order's widest path by price, and the least weight on its rows."""
    g = priced_rings(spark, sf_dir)
    trees = materialize(path_tables.best_trees(g, g.nodes.where(_HUBS).select("id"), MAX_MIN), "trees")
    steps = path_tables.path_rows(trees).withColumn("before", F.lag("node").over(Window.partitionBy("src", "dst").orderBy("position")))
    both = g.edges.select(F.col("src").alias("before"), F.col("dst").alias("node"), "w").union(g.edges.select("dst", "src", "w"))
    least = steps.join(both, ["before", "node"]).groupBy("src", "dst").agg(F.min("w").alias("least"))
    return trees.join(least, ["src", "dst"]).select("src", "dst", F.col("dist").alias("width"), "least")


register(
    "widest_paths_priced", f"""WITH {_PRICED},
    d AS (SELECT hub, o_orderkey, ring, k, fp, closing, MIN(CASE WHEN k > 1 THEN step END) OVER (PARTITION BY o_custkey ORDER BY k) AS ahead,
      MIN(step) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest FROM e),
    w AS (SELECT hub AS src, o_orderkey AS dst, greatest(least(fp, coalesce(ahead, fp)), CASE WHEN ring AND k > 1 THEN least(fp, closing, coalesce(rest, closing)) ELSE 0 END) AS width FROM d)
    SELECT src, dst, CAST(width AS BIGINT) AS width, CAST(width AS BIGINT) AS least FROM w""", ring_widths,
)


# ---- matchings with their proof


def chain_matching(spark, sf_dir):
    """Matched pairs of orders that follow each other, by customer."""
    g = ds.order_chain(spark, sf_dir)
    pairs = matching_rows(Graph(g.nodes, g.edges, False)).pairs
    owner = ds.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    ends = pairs.select(F.explode(F.array("l", "r")).alias("id"), F.lit(1).alias("half"))
    return owner.join(ends, "id", "left").groupBy("o_custkey").agg((F.count("half") / 2).cast("long").alias("pairs"))


register(
    "matching_chain", """SELECT o_custkey, CAST(c // 2 AS BIGINT) AS pairs FROM (SELECT o_custkey, COUNT(*) AS c FROM orders GROUP BY 1)
    """, chain_matching,
)


def buyers_matching(spark, sf_dir):
    """Size of a largest matching of customers and the suppliers of their lines, with its proof."""
    line = ds.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("r"))
    orders = ds.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("l"))
    arcs = materialize(line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l", "r").distinct(), "bought")
    found = matching_rounds.bipartite_rows(arcs)
    cover = materialize(found.cover, "cover")
    open_ = arcs.join(cover.where("side = 0").select(F.col("id").alias("l")), "l", "left_anti").join(cover.where("side = 1").select(F.col("id").alias("r")), "r", "left_anti")
    once = found.pairs.agg(F.count_distinct("l").alias("l"), F.count_distinct("r").alias("r")).first()
    false = found.pairs.join(arcs, ["l", "r"], "left_anti").count()
    return one_row(spark, size=found.size, left=once["l"], right=once["r"], cover=cover.count(), uncovered=open_.count(), strangers=false)


register(
    "matching_cover_bought", """WITH b AS (SELECT DISTINCT o_custkey AS l, l_suppkey AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    s AS (SELECT least(COUNT(DISTINCT l), COUNT(DISTINCT r)) AS size FROM b)
    SELECT size, size AS "left", size AS "right", size AS cover, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS strangers FROM s""", buyers_matching,
)


# ---- maximal cliques

#: Days within which two orders of a customer are joined.
DAYS = 200


def order_cliques(spark, sf_dir):
    """Maximal sets of a customer's orders that all lie within ``DAYS``: size, first, last and sum of keys."""
    orders = ds.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    other = orders.select("o_custkey", F.col("o_orderkey").alias("dst"), F.col("day").alias("then"))
    near = orders.join(other, "o_custkey").where(F.col("o_orderkey") < F.col("dst")).where(F.abs(F.datediff("then", "day")) <= DAYS)
    edges = materialize(near.select(F.col("o_orderkey").alias("src"), "dst", F.lit(1).cast("long").alias("w")), "near")
    g = Graph(orders.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("data")), edges, False)
    keys = F.col("clique")
    return maximal_clique_rows(g).select(F.size(keys).cast("long").alias("size"), F.array_min(keys).alias("low"), F.array_max(keys).alias("high"), F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


#: Orders by day: a window is maximal if it ends later than the window of the order before.
register(
    "maximal_cliques_orders", f"""WITH o AS (
      SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS rn FROM orders),
    e AS (SELECT a.o_custkey, a.rn, MAX(b.rn) AS final FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.rn >= a.rn AND b.day <= a.day + {DAYS} GROUP BY 1, 2),
    w AS (SELECT *, LAG(final) OVER (PARTITION BY o_custkey ORDER BY rn) AS before FROM e)
    SELECT COUNT(*) AS size, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high, CAST(SUM(o_orderkey) AS BIGINT) AS total
    FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.rn BETWEEN w.rn AND w.final WHERE before IS NULL OR final > before GROUP BY w.o_custkey, w.rn""", order_cliques,
)


# ---- flows: source -> nation -> customer -> order priority -> sink

_SOURCE, _SINK, _PRIORITY = 1, 2, 10


def order_network(spark, sf_dir) -> Graph:
    """Capacities: two thirds of a nation's orders, three quarters of a customer's, each priority's orders of a customer, and a share of each priority's."""
    customer = ds.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey").cast("long") + ds.NATION).alias("nation"))
    orders = ds.table(spark, sf_dir, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("p"))
    sold = materialize(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("nation", (F.col("o_custkey") + ds.CUSTOMER).alias("who"), "p").agg(F.count("*").alias("n")), "sold")
    link = lambda df, src, dst, w: df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.floor(w).cast("long").alias("w"))
    n = F.sum("n").alias("n")
    edges = (
        link(sold.groupBy("nation").agg(n), F.lit(_SOURCE), F.col("nation"), F.col("n") * 2 / 3)
        .union(link(sold.groupBy("nation", "who").agg(n), F.col("nation"), F.col("who"), (F.col("n") * 3 + 3) / 4))
        .union(link(sold, F.col("who"), F.col("p") + _PRIORITY, F.col("n")))
        .union(link(sold.groupBy("p").agg(n), F.col("p") + _PRIORITY, F.lit(_SINK), F.col("n") * (F.col("p") + 2) / 10))
    )
    return Graph.from_frames(None, materialize(edges, "network"), True)


def network_flow(spark, sf_dir):
    """Value of a largest flow, weight of its cut, and what would disprove it: overfull arcs and nodes that keep something."""
    g = order_network(spark, sf_dir)
    found = max_flow_rows(g, _SOURCE, _SINK)
    flow, cut = materialize(found.flow, "flow"), materialize(found.cut, "cut")
    side = lambda k: cut.select(F.col("id").alias(k), F.col("side").alias(f"{k}_side"))
    across = g.edges.join(side("src"), "src").join(side("dst"), "dst").where("src_side = 'S' AND dst_side = 'T'").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()["w"]
    over = flow.join(g.edges, ["src", "dst"], "left").where("w IS NULL OR f > w").count()
    net = flow.select("src", -F.col("f")).union(flow.select("dst", "f")).toDF("id", "f").groupBy("id").agg(F.sum("f").alias("f"))
    kept = net.where(~F.col("id").isin(_SOURCE, _SINK) & (F.col("f") != 0)).count()
    return one_row(spark, value=int(found.value), cut=int(across), overfull=over, kept=kept)


#: Every set of priorities on the source's side of a cut gives the least cut with it: the least over all 32 is the flow.
_CUTS = """WITH s AS (
  SELECT c_nationkey AS nation, o_custkey AS who, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p, COUNT(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
b AS (SELECT unnest(range(32)) AS b),
c AS (SELECT b, nation, who, least((SUM(n) * 3 + 3) // 4, SUM(CASE WHEN (b >> (p - 1)) & 1 = 0 THEN n ELSE 0 END)) AS w FROM s, b GROUP BY 1, 2, 3),
k AS (SELECT nation, SUM(n) * 2 // 3 AS most FROM s GROUP BY 1),
m AS (SELECT b, SUM(least(most, w)) AS w FROM (SELECT b, nation, SUM(w) AS w FROM c GROUP BY 1, 2) JOIN k USING (nation) GROUP BY 1),
q AS (SELECT b, SUM(CASE WHEN (b >> (p - 1)) & 1 = 1 THEN all_n * (p + 2) // 10 ELSE 0 END) AS w FROM (SELECT p, SUM(n) AS all_n FROM s GROUP BY 1), b GROUP BY 1),
v AS (SELECT MIN(m.w + q.w) AS v FROM m JOIN q USING (b))
SELECT CAST(v AS BIGINT) AS value, CAST(v AS BIGINT) AS cut, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS kept FROM v"""
register("max_flow_orders", _CUTS, network_flow)


# ---- Euler tours and bridges by rounds


def chain_walks(spark, sf_dir):
    """The walk over each customer's orders, a row a step."""
    g = ds.order_chain(spark, sf_dir)
    return euler_path_rows(g.edges.select(F.col("src").alias("edge"), "src", "dst"), True)


register(
    "euler_path_chain", f"""WITH {ds.CHAIN} SELECT MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS component, CAST(rn - 1 AS BIGINT) AS position, o_orderkey AS src, dst, o_orderkey AS edge
    FROM placed WHERE dst IS NOT NULL""", chain_walks,
)


def doubled_tours(spark, sf_dir):
    """Tours over ``rings`` with every edge twice: length by hub, steps that don't go on from the last, edges not walked exactly once."""
    g = rings(spark, sf_dir)
    twice = g.edges.select("src", "dst", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    edges = materialize(dense_ids(twice.withColumn("key", F.struct("src", "dst", "copy")), "key", "edge").select("edge", "src", "dst"), "doubled")
    tour = materialize(euler_rows(edges, False), "tour")
    after = tour.select("component", (F.col("position") - 1).alias("position"), F.col("src").alias("goes_on"))
    size = tour.groupBy("component").agg(F.count("*").alias("length"), F.max(F.when(F.col("src") >= ds.PART, F.col("src"))).alias("hub"))
    wrap = after.join(size, "component").select("component", F.pmod("position", "length").alias("position"), "goes_on")
    steps = tour.join(wrap, ["component", "position"], "left")
    kept = edges.select("edge", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    walked = steps.join(kept, "edge").withColumn("broken", (F.coalesce(F.col("goes_on") != F.col("dst"), F.lit(True)) | (F.least("src", "dst") != F.col("a")) | (F.greatest("src", "dst") != F.col("b"))).cast("long"))
    sums = walked.groupBy("component").agg(F.sum("broken").alias("broken"), F.count_distinct("edge").alias("edges"))
    return sums.join(size, "component").select("hub", "length", "edges", "broken")


register(
    "euler_tours_doubled", f"""WITH {RINGS}, own AS (SELECT hub, o_orderkey AS id FROM placed)
    SELECT hub, CAST(2 * COUNT(*) AS BIGINT) AS length, CAST(2 * COUNT(*) AS BIGINT) AS edges, CAST(0 AS BIGINT) AS broken FROM rings JOIN own ON own.id = src GROUP BY 1""", doubled_tours,
)
on_rings("bridges_rounds_rings", "SELECT src AS u, dst AS v FROM rings WHERE bridge", lambda g: blocks.bridges_and_cuts(g)[0])
