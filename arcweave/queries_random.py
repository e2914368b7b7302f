"""Queries of random models as large as the tables: what every draw must hold, and counts near their expectation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from arcweave import datasets as ds
from arcweave.generators import classes, rand
from arcweave.model import Graph
from arcweave.plans.materialize import materialize
from arcweave.queries import one_row
from arcweave.queries_extra import register
from arcweave.queries_more import RINGS, rings


def size(spark, sf_dir, table: str) -> int:
    return ds.table(spark, sf_dir, table).count()


def facts(spark, g: Graph, directed: bool = False):
    """Counts of nodes, edges, different pairs and loops, and the least and greatest degree."""
    edges = materialize(g.edges.select("src", "dst"), "drawn")
    pair = ["src", "dst"] if directed else [F.least("src", "dst"), F.greatest("src", "dst")]
    row = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).first()
    return one_row(spark, nodes=g.order(), edges=row["edges"], pairs=edges.select(*pair).distinct().count(), loops=row["loops"])


_FACTS = 'SELECT n AS nodes, CAST({edges} AS BIGINT) AS edges, CAST({edges} AS BIGINT) AS pairs, CAST(0 AS BIGINT) AS loops FROM (SELECT COUNT(*) AS n FROM customer)'

register(
    "random_gnm_customers", "SELECT n AS nodes, least(m, n * (n - 1) // 2) AS edges, least(m, n * (n - 1) // 2) AS pairs, CAST(0 AS BIGINT) AS loops FROM (SELECT COUNT(*) AS n FROM customer), (SELECT COUNT(*) AS m FROM orders)",
    lambda spark, sf_dir: facts(spark, rand.erdos_renyi_gnm(size(spark, sf_dir, "customer"), size(spark, sf_dir, "orders"), 1)),
)
register("random_small_world_customers", _FACTS.format(edges="2 * n"), lambda spark, sf_dir: facts(spark, rand.watts_strogatz(size(spark, sf_dir, "customer"), 4, 0.25, 1)))


def preferential_customers(spark, sf_dir):
    """How many nodes have how many edges to earlier ones."""
    g = rand.barabasi_albert(size(spark, sf_dir, "customer"), 2, 1, True)
    return g.edges.select(F.greatest("src", "dst").alias("late")).groupBy("late").agg(F.count("*").alias("earlier")).groupBy("earlier").agg(F.count("*").alias("nodes"))


register("random_preferential_customers", "SELECT unnest([1, 2]) AS earlier, unnest([1, n - 2]) AS nodes FROM (SELECT COUNT(*) AS n FROM customer)", preferential_customers)


def regular_customers(spark, sf_dir):
    """How many nodes have which degree."""
    g = rand.random_regular(size(spark, sf_dir, "customer"), 4, 1)
    return g.degrees().groupBy(F.col("degree").cast("long").alias("degree")).agg(F.count("*").alias("nodes"))


register("random_regular_customers", "SELECT CAST(4 AS BIGINT) AS degree, COUNT(*) AS nodes FROM customer", regular_customers)


def degrees_rings(spark, sf_dir):
    """Degrees and different neighbours in another graph of the degrees of ``rings``."""
    made = rand.randomize_degree_sequence(rings(spark, sf_dir), 1, allow_loops=False, allow_multi=False)
    both = materialize(made.edges.select("src", "dst").union(made.edges.select("dst", "src")), "both")
    return both.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.count_distinct("dst").alias("neighbors"))


register("random_degrees_rings", f"WITH {RINGS} SELECT id, COUNT(*) AS degree, COUNT(*) AS neighbors FROM (SELECT src AS id FROM rings UNION ALL SELECT dst FROM rings) GROUP BY 1", degrees_rings)


def near(found: float, expected: float) -> bool:
    """Within six standard deviations of a sum of independent draws."""
    return abs(found - expected) <= 6 * math.sqrt(expected) + 1


def blocks_customers(spark, sf_dir):
    """Edges inside and between degree-corrected blocks of Poisson weights, and by level of a tree of blocks, near their expectation."""
    n, k, inside, between = size(spark, sf_dir, "customer"), 5, 0.02, 0.004
    raw = classes.weights(n, 1, "poisson", 2.5, 3.0)
    t = F.col("raw")
    sums = raw.groupBy((F.col("id") % k).alias("block")).agg(F.sum(t).alias("s"), F.sum(t * t).alias("q")).collect()
    total, scale = sum(r["s"] for r in sums), (n / sum(r["s"] for r in sums)) ** 2
    own = sum(r["s"] ** 2 for r in sums)
    want = [inside * scale * (own - sum(r["q"] for r in sums)) / 2, between * scale * (total**2 - own) / 2]
    same = F.count_if(F.col("src") % k == F.col("dst") % k).alias("same")
    got = rand.dcsbm(n, k, inside, between, 1, "poisson").edges.agg(same, F.count("*").alias("all")).first()
    chances, leaves = [0.001, 0.004, 0.02], 4
    sizes = [(n - i + leaves - 1) // leaves for i in range(leaves)]
    pairs = [(sizes[0] + sizes[1]) * (sizes[2] + sizes[3]), sizes[0] * sizes[1] + sizes[2] * sizes[3], sum(m * (m - 1) // 2 for m in sizes)]
    level = F.when(F.col("src") % 4 == F.col("dst") % 4, 2).when(F.expr("src % 4 div 2 = dst % 4 div 2"), 1).otherwise(0)
    by_level = {r["level"]: r["n"] for r in rand.hsbm(n, 2, 2, chances, 1).edges.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    tree = all(near(by_level.get(i, 0), p * m) for i, (p, m) in enumerate(zip(chances, pairs, strict=True)))
    return one_row(spark, nodes=n, inside=near(got["same"], want[0]), between=near(got["all"] - got["same"], want[1]), tree=tree)


register("random_blocks_customers", 'SELECT COUNT(*) AS nodes, TRUE AS inside, TRUE AS between, TRUE AS tree FROM customer'.replace("AS between", 'AS "between"'), blocks_customers)
