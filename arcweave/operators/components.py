"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on node ids.  Hubs are safe: the
smallest neighbour of a node is a partial aggregate, and the join that brings
it back is spread over ``SALTS`` keys per node, so that the edges of one node
never have to meet in one task.  The number of rounds is logarithmic in the
longest path for all practical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.materialize import discard, materialize, stat

#: Keys over which the edges of one node are spread.
SALTS = 8


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its partners v."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = (
        pairs.groupBy("u")
        .agg(F.least(F.min("v"), F.col("u")).alias("m"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def _state() -> dict:
    """What tells one round's edges (u <> v) from the next's, taken while they are written."""
    edge = F.col("u") != F.col("v")
    return {"n": F.count_if(edge), "s": F.sum(F.when(edge, F.xxhash64("u", "v").cast("decimal(38,0)")))}


def component_links(links: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in ``links``.

    The component is the smallest node reachable.  Nulls are ignored, loops
    give a component of one node, repeated links count once.
    """
    links = links.select(F.col(u).alias("u"), F.col(v).alias("v")).dropna()
    start = materialize(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", **_state()
    )
    edges, written = start.where("u <> v"), None
    before = stat(start, "n"), stat(start, "s")
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        near = _with_least(large.distinct())
        small = (
            near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(near.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        old, written = written, materialize(small, "round", **_state())
        discard(old)  # only the newest round is read from here on
        edges = written
        after = stat(written, "n"), stat(written, "s")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = start.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(edges.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
