"""Graphs seen in the driver's tables, as DataFrames and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.model import Graph
from arcweave.plans.materialize import materialize

#: Offset of part ids beside supplier ids, and of the tree's levels.
PART, NATION, CUSTOMER, SUPPLIER = 1_000_000_000_000, 1_000, 1_000_000, 2_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer nation -> supplier nation, weighted by the number of lines sold."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    sold = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    edges = sold.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.count("*").alias("w"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("data"))
    return Graph(nodes, materialize(edges, "trade"), True)


TRADE = """trade AS (
  SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, COUNT(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS data FROM nation)"""


def flow(spark: SparkSession, sf_dir: str) -> Graph:
    """User -> the user of the next event in the same hour, weighted by how often."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    w = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    steps = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst IS NOT NULL AND src <> dst")
    edges = materialize(steps.groupBy("src", "dst").agg(F.count("*").alias("w")), "flow")
    nodes = events.select(F.col("user_id").alias("id")).distinct().withColumn("data", F.lit(None).cast("string"))
    return Graph(nodes, edges, True)


FLOW = """steps AS (
  SELECT user_id AS src, LEAD(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events),
flow AS (SELECT src, dst, COUNT(*) AS w FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
nodes AS (SELECT DISTINCT user_id AS id FROM events)"""


def geo_tree(spark: SparkSession, sf_dir: str) -> Graph:
    """A root (0), regions (1 + key), nations, customers and suppliers below; weight 1."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    long = lambda c, n: (F.col(c).cast("long") + F.lit(n)).cast("long")
    edges = (
        region.select(F.lit(0).cast("long").alias("src"), long("r_regionkey", 1).alias("dst"))
        .union(nation.select(long("n_regionkey", 1), long("n_nationkey", NATION)))
        .union(customer.select(long("c_nationkey", NATION), long("c_custkey", CUSTOMER)))
        .union(supplier.select(long("s_nationkey", NATION), long("s_suppkey", SUPPLIER)))
    )
    return Graph.from_frames(None, materialize(edges.withColumn("w", F.lit(1).cast("long")), "tree"), True)


TREE = f"""tree AS (
  SELECT CAST(0 AS BIGINT) AS src, CAST(r_regionkey AS BIGINT) + 1 AS dst FROM region
  UNION ALL SELECT CAST(n_regionkey AS BIGINT) + 1, CAST(n_nationkey AS BIGINT) + {NATION} FROM nation
  UNION ALL SELECT CAST(c_nationkey AS BIGINT) + {NATION}, c_custkey + {CUSTOMER} FROM customer
  UNION ALL SELECT CAST(s_nationkey AS BIGINT) + {NATION}, s_suppkey + {SUPPLIER} FROM supplier)"""


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Each order -> the same customer's next order; the weight is its price in whole units."""
    orders = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = orders.select(
        F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"), F.floor("o_totalprice").cast("long").alias("w")
    ).where("dst IS NOT NULL")
    nodes = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("data"))
    return Graph(nodes, materialize(steps, "chain"), True)


CHAIN = """placed AS (
  SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS w,
         LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders),
chain AS (SELECT o_orderkey AS src, dst, w FROM placed WHERE dst IS NOT NULL)"""


def supp_part(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and the parts (offset ids) they sold, undirected; the weight counts lines."""
    line = table(spark, sf_dir, "lineitem")
    edges = line.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst")).agg(F.count("*").alias("w"))
    return Graph.from_frames(None, materialize(edges, "sold"), False)


SOLD = f"sold AS (SELECT l_suppkey AS src, l_partkey + {PART} AS dst, COUNT(*) AS w FROM lineitem GROUP BY 1, 2)"
