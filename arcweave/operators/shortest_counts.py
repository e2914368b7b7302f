"""Sums over shortest paths from many sources: distances, counts of paths, dependencies.

Sources go in blocks of ``BLOCK``, so that what is held at a time is the rows
of a block and not the square of the graph.  Everything is joins with the arcs
and partial aggregates keyed by (source, node); no graph is collected or
broadcast.

Dependencies by hops (every weight one): a forward sweep writes one table of
new nodes and path counts a level; a backward sweep takes the levels from the
last to the first, each once.  By weights: the arcs that lie on shortest paths
are found once, counts go forward over them a hop a round, and shares come
back over them likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators.paths import distances_from
from arcweave.plans.materialize import discard, materialize, stat

#: Sources that go together.
BLOCK = 10_000


def blocks(ids: DataFrame, block: int = BLOCK) -> Iterator[DataFrame]:
    """``ids`` (id) in parts of about ``block`` rows, by hash."""
    parts = -(-ids.count() // block)
    for b in range(parts):
        yield ids if parts == 1 else ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == b)


def distance_sums(g: Graph, sources: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(id, reached, total, farthest, inverse) of each of ``sources`` (id; all nodes).

    Counts what it reaches (itself included), sums distances, takes the largest
    and sums 1 / distance of those above 0.
    """
    kind = "id long, reached long, total double, farthest double, inverse double"
    done = [g.nodes.sparkSession.createDataFrame([], kind)]
    for ids in blocks((g.nodes if sources is None else sources).select("id"), block):
        dist = F.col("dist").cast("double")
        sums = distances_from(g, ids).groupBy(F.col("src").alias("id")).agg(
            F.count("*").alias("reached"), F.sum(dist).alias("total"), F.max(dist).alias("farthest"),
            F.coalesce(F.sum(F.when(dist > 0, 1 / dist)), F.lit(0.0)).alias("inverse"),
        )
        done.append(materialize(sums, "sums"))
    return reduce(DataFrame.union, done)


def _arcs(g: Graph) -> DataFrame:
    return materialize(g.arcs().where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("x"), "w"), "arcs", low=F.min("w"))


def _by_hops(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, part): dependencies where every arc counts one."""
    one = F.lit(1.0)
    start = sources.select(F.col("id").alias("s"), F.col("id").alias("v"), one.alias("sigma"))
    levels, seen = [materialize(start, "level", n=F.count("*"))], start.select("s", "v")
    while stat(levels[-1], "n"):
        met = levels[-1].join(arcs, F.col("v") == F.col("u")).groupBy("s", F.col("x").alias("v")).agg(F.sum("sigma").alias("sigma"))
        levels.append(materialize(met.join(seen, ["s", "v"], "left_anti"), "level", n=F.count("*")))
        seen = reduce(DataFrame.union, [k.select("s", "v") for k in levels])
    shares, back = [], None
    for h in range(len(levels) - 2, 0, -1):
        level, above = levels[h], levels[h - 1]
        # of each node here: 1 / its count, and what came back to it
        known = level if back is None else level.join(back, ["s", "v"], "left")
        share = (1 / F.col("sigma") + (F.lit(0.0) if back is None else F.coalesce("e", F.lit(0.0)))).alias("e")
        given = known.select("s", "v", share)
        if stat(above, "n") < stat(level, "n"):
            # few rows above: they ask their successors instead of being told by all of them
            asked = above.select("s", F.col("v").alias("u")).join(arcs, "u").select("s", "u", F.col("x").alias("v"))
            back = asked.join(given, ["s", "v"]).groupBy("s", F.col("u").alias("v")).agg(F.sum("e").alias("e"))
        else:
            told = given.join(arcs, F.col("v") == F.col("x")).groupBy("s", F.col("u").alias("v")).agg(F.sum("e").alias("e"))
            back = told.join(above.select("s", "v"), ["s", "v"], "left_semi")
        back = materialize(back, "back")
        shares.append(back.join(above, ["s", "v"]).where("s <> v").select("v", (F.col("e") * F.col("sigma")).alias("part")))
    return _summed(shares, arcs, levels)


def _by_weights(g: Graph, arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, part): dependencies along paths of least weight; weights are above 0."""
    dist = materialize(distances_from(g, sources), "dist")
    at, to = (dist.select(F.col("src").alias("s"), F.col("dst").alias(k), F.col("dist").alias(d)) for k, d in (("u", "du"), ("x", "dx")))
    tight = materialize(at.join(arcs, "u").join(to, ["s", "x"]).where(F.col("du") + F.col("w") == F.col("dx")).select("s", "u", "x"), "tight")
    hops = [materialize(sources.select(F.col("id").alias("s"), F.col("id").alias("u"), F.lit(1.0).alias("c")), "hop", n=F.count("*"))]
    while stat(hops[-1], "n"):
        hops.append(materialize(hops[-1].join(tight, ["s", "u"]).groupBy("s", F.col("x").alias("u")).agg(F.sum("c").alias("c")), "hop", n=F.count("*")))
    sigma = materialize(reduce(DataFrame.union, hops).groupBy("s", F.col("u").alias("v")).agg(F.sum("c").alias("sigma")), "sigma")
    discard(*hops)
    back = [materialize(sigma.where("s <> v").select("s", "v", (1 / F.col("sigma")).alias("e")), "back", n=F.count("*"))]
    while stat(back[-1], "n"):
        last = back[-1].withColumnRenamed("v", "x")
        back.append(materialize(last.join(tight, ["s", "x"]).groupBy("s", F.col("u").alias("v")).agg(F.sum("e").alias("e")), "back", n=F.count("*")))
    shares = [b.join(sigma, ["s", "v"]).where("s <> v").select("v", (F.col("e") * F.col("sigma")).alias("part")) for b in back[1:-1]]
    return _summed(shares, dist, tight, sigma, *back)


def _summed(shares: list[DataFrame], like: DataFrame, *held) -> DataFrame:
    none = like.sparkSession.createDataFrame([], "id long, part double")
    if not shares:
        return none
    out = materialize(reduce(DataFrame.union, shares).groupBy(F.col("v").alias("id")).agg(F.sum("part").alias("part")), "part")
    discard(*(x for h in held for x in (h if isinstance(h, list) else [h])))
    return out


def dependencies(g: Graph, sources: DataFrame | None = None, weighted: bool = True, block: int = BLOCK) -> DataFrame:
    """(id, part): of all pairs (source, other), the shares of shortest paths on which a node lies between, summed.

    With ``weighted`` every weight must be above 0.
    """
    arcs = _arcs(g)
    low = stat(arcs, "low")
    if weighted and low is not None and low <= 0:
        raise ValueError("dependencies along weights need weights above 0")
    done = [g.nodes.sparkSession.createDataFrame([], "id long, part double")]
    for ids in blocks((g.nodes if sources is None else sources).select("id"), block):
        done.append(_by_weights(g, arcs, ids) if weighted else _by_hops(arcs, ids))
    return reduce(DataFrame.union, done).groupBy("id").agg(F.sum("part").alias("part"))
