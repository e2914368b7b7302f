"""Models whose pairs have unlike probabilities, drawn by classes of pairs with nearly the same one.

Each class draws its pairs by jumps with the largest probability any of them
has, and thins; classes are cut so that this lists a small multiple of the
edges, however skewed weights or distances are.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.generators.classic import _ids
from arcweave.generators.draws import around, drawn, uniform
from arcweave.model import dense_ids
from arcweave.plans.materialize import materialize, stat


def weights(n: int, seed: int, theta: str | Callable[[random.Random], float], gamma: float, mean: float) -> DataFrame:
    """(id, raw): a weight for each node, drawn in tasks from a hash of (seed, id)."""
    ids, u = _ids(n), uniform(seed, F.col("id"))
    if callable(theta):

        def draw(batches):
            for batch in batches:
                found = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([float(theta(random.Random(f"{seed}:{i}"))) for i in found], pa.float64())], names=["id", "raw"])

        return ids.mapInArrow(draw, "id long, raw double")
    if theta == "power_law":
        return ids.select("id", F.pow(1 - u, -1 / (gamma - 1)).alias("raw"))
    # counts of a Poisson law by its distribution function, none below 1
    upto, term, bounds = 0.0, math.exp(-mean), []
    for i in range(1, int(mean + 12 * math.sqrt(mean) + 40)):
        upto += term
        bounds.append(upto)
        term *= mean / i
    return ids.select("id", F.greatest(F.lit(1.0), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= u)).cast("double")).alias("raw"))


def _named(groups: DataFrame, prefix: str) -> DataFrame:
    return groups.select("block", *[F.col(c).alias(prefix + c) for c in ("level", "at", "size")])


def _rank_pairs(same: Column, at_a: str, size_a: str, at_b: str, size_b: str) -> tuple[Column, Column]:
    """Ranks that number k of a pair of groups stands for."""
    x, y = around(size_a)
    left = F.when(same, x).otherwise(F.expr(f"k div {size_b}")) + F.col(at_a)
    right = F.when(same, y).otherwise(F.expr(f"k % {size_b}")) + F.col(at_b)
    return left, right


def _count(same: Column, a: str, b: str) -> Column:
    return F.when(same, F.expr(f"{a} * ({a} - 1) div 2")).otherwise(F.col(a) * F.col(b))


def corrected_blocks(n: int, k: int, p_in: float, p_out: float, seed: int, raw: DataFrame) -> DataFrame:
    """(src, dst): each pair with probability theta * theta * p of its blocks, at most 1; thetas are ``raw`` scaled to a mean of 1.

    Nodes are ranked by (power of two below theta, block), so those of like
    theta are a range of ranks; a pair of such ranges draws with at most four
    times any of its pairs' probability.
    """
    held = materialize(raw.where("raw > 0"), "raw", total=F.sum("raw"))
    if not stat(held, "total"):
        return _ids(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    t = F.col("raw") * (n / stat(held, "total"))
    nodes = held.select("id", t.alias("t"), (F.col("id") % k).alias("block")).withColumn("level", F.floor(F.log2("t")).cast("int"))
    ranked = materialize(dense_ids(nodes.withColumn("key", F.struct("level", "block", "id")), "key", "rank").drop("key"), "thetas")
    span = [F.min("rank").alias("at"), F.count("*").alias("size")]
    # blocks below 0 stand for all of them
    inner = ranked.groupBy("block", "level").agg(*span)
    outer = ranked.groupBy("level").agg(*span).select(F.lit(-1).cast("long").alias("block"), "level", "at", "size")
    same = F.col("alevel") == F.col("blevel")
    found = []
    for groups, p0 in ((inner, p_in), (outer, p_out if k > 1 else 0.0)):
        both = _named(groups, "a").join(_named(groups, "b"), "block").where("alevel <= blevel").withColumn("p0", F.lit(float(p0)))
        top = F.least(F.lit(1.0), F.col("p0") * F.pow(F.lit(2.0), F.col("alevel") + F.col("blevel") + 2) * (1 + 1e-9))
        found.append(both.select("*", _count(same, "asize", "bsize").alias("m"), top.alias("p")))
    pairs = drawn(found[0].union(found[1]), ["block", "alevel", "blevel"], seed + 1)
    left, right = _rank_pairs(same, "aat", "asize", "bat", "bsize")
    pairs = pairs.select(F.col("block") < 0, "p0", "p", left.alias("ra"), right.alias("rb")).toDF("out", "p0", "p", "ra", "rb")
    side = lambda r, x: ranked.select(F.col("rank").alias(r), F.col("id").alias(x), F.col("t").alias(f"t{x}"), F.col("block").alias(f"b{x}"))
    met = pairs.join(side("ra", "src"), "ra").join(side("rb", "dst"), "rb").where(~F.col("out") | (F.col("bsrc") != F.col("bdst")))
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return met.where(uniform(seed + 2, low, high) * F.col("p") < F.col("tsrc") * F.col("tdst") * F.col("p0")).select(low.alias("src"), high.alias("dst"))


def block_tree(n: int, branching: int, depth: int, probabilities: list[float], seed: int) -> DataFrame:
    """(src, dst): pairs with the probability of the level where their leaves (id modulo their number) part.

    Every inner block draws among all pairs below it and drops those of one
    child, at most one in ``branching``; members are numbered by arithmetic.
    """
    leaves, parts = branching**depth, []
    for level in range(depth + 1):
        width = branching ** (depth - level)
        rest = F.least(F.greatest(F.lit(n % leaves) - F.col("id") * width, F.lit(0)), F.lit(width))
        p = min(1.0, float(probabilities[min(level, len(probabilities) - 1)]))
        groups = _ids(-(-min(leaves, n) // width)).select(F.col("id").alias("block"), F.lit(level).alias("level"), F.lit(width).cast("long").alias("width"), (F.lit(n // leaves) * width + rest).cast("long").alias("n"))
        parts.append(groups.withColumn("p", F.lit(p)))
    groups = parts[0]
    for more in parts[1:]:
        groups = groups.union(more)
    pairs = drawn(groups.withColumn("m", F.expr("n * (n - 1) div 2")), ["level", "block"], seed)
    for name, j in zip(("src", "dst"), around("n"), strict=True):
        pairs = pairs.withColumn("j", j).withColumn(name, F.expr(f"(j div width) * {leaves} + block * width + j % width"))
    child = lambda c: F.expr(f"({c} % {leaves}) div greatest(width div {branching}, 1)")
    return pairs.where((F.col("level") == depth) | (child("src") != child("dst"))).select("src", "dst")


def by_distance(n: int, points: DataFrame, alpha: float, beta: float, seed: int) -> DataFrame:
    """(src, dst): points (id, x0, x1) of the unit square with probability beta * exp(-d / (alpha * sqrt 2)).

    Cells are quartered until they are half of ``alpha`` wide or hold about
    four points.  A pair of cells draws at the level where it is first apart
    (its parents touched), or at the last, with the probability of its least
    distance: what is listed is a constant multiple of the edges for any alpha.
    Points are ranked along the quarters, so a cell of any level is a range.
    """
    fine = max(0, math.ceil(math.log2(2 / alpha))) if alpha > 0 else 20
    levels = max(0, min(fine, int(math.log(max(n, 4) / 4, 4)), 20))
    cell = lambda x: F.least(F.floor(F.col(x) * (1 << levels)), F.lit((1 << levels) - 1)).cast("long")
    here = points.select("id", "x0", "x1", cell("x0").alias("cx"), cell("x1").alias("cy"))
    z = F.lit(0).cast("long")
    for i in range(levels):
        z = z + F.expr(f"((cx >> {i}) & 1) * {1 << 2 * i} + ((cy >> {i}) & 1) * {2 << 2 * i}")
    ranked = materialize(dense_ids(here.withColumn("key", F.struct(z.alias("z"), "id")), "key", "rank").drop("key"), "points")
    pairs = None
    for level in range(levels + 1):
        up = levels - level
        cells = materialize(ranked.groupBy(F.expr(f"cx >> {up}").alias("x"), F.expr(f"cy >> {up}").alias("y")).agg(F.min("rank").alias("at"), F.count("*").alias("size")), "cells")
        ways = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in range(4) for j in range(-3, 4) if (i, j) >= (0, 0)])
        a = cells.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("at").alias("aat"), F.col("size").alias("asize"), F.explode(ways).alias("w"))
        a = a.select("*", "w.i", "w.j", (F.col("ax") + F.col("w.i")).alias("bx"), (F.col("ay") + F.col("w.j")).alias("by")).drop("w")
        apart = F.greatest("i", F.abs("j")) >= 2
        above = F.greatest(F.abs(F.expr("(bx >> 1) - (ax >> 1)")), F.abs(F.expr("(by >> 1) - (ay >> 1)"))) <= 1
        a = a.where((apart if level < levels else F.lit(True)) & (above if level else F.lit(True)))
        both = a.join(cells.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("at").alias("bat"), F.col("size").alias("bsize")), ["bx", "by"])
        gap = lambda c: F.greatest(F.abs(c) - 1, F.lit(0)).cast("double")
        least = F.sqrt(gap("i") * gap("i") + gap("j") * gap("j")) / float(1 << level)
        m = _count((F.col("i") == 0) & (F.col("j") == 0), "asize", "bsize")
        told = both.select(F.lit(level).alias("level"), "ax", "ay", "bx", "by", "aat", "asize", "bat", "bsize", m.alias("m"), F.least(F.lit(1.0), _chance(least, alpha, beta)).alias("p"))
        pairs = told if pairs is None else pairs.union(told)
    found = drawn(pairs, ["level", "ax", "ay", "bx", "by"], seed + 1)
    left, right = _rank_pairs((F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")), "aat", "asize", "bat", "bsize")
    side = lambda r, s: ranked.select(F.col("rank").alias(r), F.col("id").alias(s), F.col("x0").alias(f"{s}x"), F.col("x1").alias(f"{s}y"))
    met = found.select("p", left.alias("ra"), right.alias("rb")).join(side("ra", "src"), "ra").join(side("rb", "dst"), "rb")
    dx, dy = F.col("srcx") - F.col("dstx"), F.col("srcy") - F.col("dsty")
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return met.where(uniform(seed + 2, low, high) * F.col("p") < _chance(F.sqrt(dx * dx + dy * dy), alpha, beta)).select(low.alias("src"), high.alias("dst"))


def _chance(distance: Column, alpha: float, beta: float) -> Column:
    return F.lit(float(beta)) * F.exp(-distance / F.lit(alpha * math.sqrt(2)))
