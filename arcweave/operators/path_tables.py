"""Paths as rows: trees of best paths by relaxation rounds, unrolled by pointer doubling.

A state is (src, dst, dist, hops, parent).  A better state has the better
distance, then fewer hops, then the smaller parent: a total order, so that the
tree doesn't depend on how rows are dealt.  Only improved rows spread, a round
is one join with the arcs and one partial aggregate, and every round's state is
a written table.

Paths come out of the tree by doubling: rows (src, goal, offset, node) with
offsets below 2 ** k are extended by the 2 ** k-th ancestors, so a path of
length h takes log2(h) joins and nothing follows parents one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.functions.semirings import MAX_MIN, MIN_PLUS, Semiring
from arcweave.model import Graph
from arcweave.operators.paths import NegativeCycle, distances_from
from arcweave.plans.fixpoint import relax
from arcweave.plans.materialize import discard, materialize, stat


def _least_arcs(g: Graph) -> DataFrame:
    """Arcs between different nodes; loops never lie on a best path but for negative ones, which are kept."""
    return g.arcs().select(F.col("src").alias("mid"), F.col("dst").alias("to"), "w").where("mid <> to OR w < 0")


def _cyclic(tree: DataFrame) -> bool:
    """Whether parents run in a circle: some node has ancestors without end."""
    jumps = materialize(tree.where("parent IS NOT NULL").select("src", F.col("dst").alias("node"), F.col("parent").alias("up")), "jumps", n=F.count("*"))
    span, n = 1, stat(jumps, "n")
    while span <= n and stat(jumps, "n"):
        # whoever has an ancestor 2 ** k up, with 2 ** k beyond the number of nodes, is on or below a circle
        a, b = jumps.alias("a"), jumps.alias("b")
        up = (F.col("a.src") == F.col("b.src")) & (F.col("a.up") == F.col("b.node"))
        old, jumps = jumps, materialize(a.join(b, up).select("a.src", "a.node", "b.up"), "jumps", n=F.count("*"))
        discard(old)
        span *= 2
    return stat(jumps, "n") > 0


def _relaxed(start: DataFrame, step: DataFrame, bound: int) -> DataFrame:
    """Fixpoint of states (src, dst, dist, hops, parent) under ``step`` (mid, to, w)."""

    def spread(fresh):
        met = fresh.join(step, fresh["dst"] == step["mid"])
        new = F.struct((F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("mid").alias("parent"))
        return met.groupBy("src", F.col("to").alias("dst")).agg(F.min(new).alias("new"))

    def merge(state, new):
        unknown, found = F.col("hops").isNull(), F.col("new").isNotNull()
        shorter = found & (unknown | (F.struct("new.dist", "new.hops") < F.struct("dist", "hops")))
        other = found & (unknown | (F.col("new") < F.struct("dist", "hops", "parent")))
        pick = lambda c: F.when(other, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
        # a smaller parent alone changes nothing for the nodes beyond
        return state.join(new, ["src", "dst"], "full_outer").select("src", "dst", pick("dist"), pick("hops"), pick("parent"), F.coalesce(shorter, F.lit(False)).alias("fresh"))

    state, rounds, taken = materialize(start, "paths"), 16, 0
    while True:
        state, settled = relax(state, spread, merge, rounds, "paths")
        if settled:
            return state.select("src", "dst", "dist", "hops", "parent")
        taken += rounds
        if taken > bound or _cyclic(state):
            raise NegativeCycle("a cycle of negative weight is reachable")
        rounds = taken  # cycles are looked for after 16, 32, 64, ... rounds


def best_trees(g: Graph, sources: DataFrame, semiring: Semiring = MIN_PLUS) -> DataFrame:
    """(src, dst, dist, hops, parent): a tree of best paths from every row of ``sources`` (id).

    MIN_PLUS: of the shortest paths those with fewest hops, then the smaller
    parent; raises :class:`NegativeCycle`.  MAX_MIN (widest): every part of a
    path from its source is widest itself; among those, fewest hops and the
    smaller parent.  A source stands at itself with null distance (MAX_MIN) or 0.
    """
    step = materialize(_least_arcs(g), "step")
    kind = step.schema["w"].dataType
    first = sources.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct()
    none = F.lit(None).cast("long")
    if semiring is MIN_PLUS:
        start = first.select("src", "dst", F.lit(0).cast(kind).alias("dist"), F.lit(0).cast("long").alias("hops"), none.alias("parent"), F.lit(True).alias("fresh"))
        return _relaxed(start, step, g.order() + 1)
    if semiring is not MAX_MIN:
        raise ValueError("trees are of shortest or of widest paths")
    width = materialize(distances_from(g, sources, MAX_MIN), "width")
    held = width.select("src", F.col("dst").alias("mid"), F.col("dist").alias("before"))
    aim = width.select("src", F.col("dst").alias("to"), F.col("dist").alias("after")).where("after IS NOT NULL")
    arc = step.groupBy("mid", "to").agg(F.max("w").alias("w"))
    # an arc is tight for a source if the best width of its end comes through it
    tight = materialize(held.join(arc, "mid").join(aim, ["src", "to"]).where(F.least("before", "w") == F.col("after")).select("src", "mid", "to"), "tight")
    hop = tight.select(F.col("src").alias("s"), "mid", "to")

    def spread(fresh):
        met = fresh.join(hop, (fresh["src"] == hop["s"]) & (fresh["dst"] == hop["mid"]))
        return met.groupBy("src", F.col("to").alias("dst")).agg(F.min(F.struct((F.col("hops") + 1).alias("hops"), F.col("mid").alias("parent"))).alias("new"))

    def merge(state, new):
        better = F.col("hops").isNull()  # breadth first: the first round that comes is the best
        pick = lambda c: F.coalesce(F.col(c), F.when(better, F.col(f"new.{c}"))).alias(c)
        return state.join(new, ["src", "dst"], "full_outer").select("src", "dst", pick("hops"), pick("parent"), better.alias("fresh"))

    begun = first.select("src", "dst", F.lit(0).cast("long").alias("hops"), none.alias("parent"), F.lit(True).alias("fresh"))
    tree, _ = relax(materialize(begun, "hops"), spread, merge, g.order() + 1, "hops")
    return tree.select("src", "dst", "hops", "parent").join(width, ["src", "dst"]).select("src", "dst", "dist", "hops", "parent")


def path_rows(trees: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, position, node, dist): the paths of ``trees`` to the (src, dst) rows of ``pairs``, or to every node.

    Position 0 is the source; dist is that of the node.  Pairs without a path
    have no rows.
    """
    goals = trees.select("src", "dst", "hops") if pairs is None else trees.join(pairs.select("src", "dst").distinct(), ["src", "dst"]).select("src", "dst", "hops")
    rows = materialize(goals.select("src", "dst", "hops", F.lit(0).cast("long").alias("offset"), F.col("dst").alias("node")), "rows", most=F.max("hops"))
    jumps = materialize(trees.where("parent IS NOT NULL").select("src", F.col("dst").alias("node"), F.col("parent").alias("up")), "jumps")
    span, most = 1, stat(rows, "most") or 0
    while span <= most:
        far = rows.join(jumps, ["src", "node"]).select("src", "dst", "hops", (F.col("offset") + span).alias("offset"), F.col("up").alias("node"))
        old_rows, rows = rows, materialize(rows.unionByName(far), "rows")
        discard(old_rows)
        span *= 2
        if span <= most:
            a, b = jumps.alias("a"), jumps.alias("b")
            up = (F.col("a.src") == F.col("b.src")) & (F.col("a.up") == F.col("b.node"))
            old, jumps = jumps, materialize(a.join(b, up).select("a.src", "a.node", "b.up"), "jumps")
            discard(old)
    dist = trees.select("src", F.col("dst").alias("node"), "dist")
    return rows.join(dist, ["src", "node"]).select("src", "dst", (F.col("hops") - F.col("offset")).alias("position"), "node", "dist")


def shortest_path_rows(g: Graph, pairs: DataFrame, semiring: Semiring = MIN_PLUS) -> DataFrame:
    """:func:`path_rows` of the best paths between the rows of ``pairs`` (src, dst)."""
    trees = materialize(best_trees(g, pairs.select(F.col("src").alias("id")), semiring), "trees")
    return path_rows(trees, pairs)
