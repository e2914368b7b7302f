"""Bridges and articulation points by relational rounds (Tarjan and Vishkin).

A spanning forest is rooted by its Euler tours, whose arcs are ranked by
list contraction; a subtree is then a range of preorder numbers, and the
smallest and largest number that its non-tree edges reach come from ranges of
doubled length.  Blocks are the components of tree edges that share a cycle.
All is joins on unique ids and partial aggregates; rounds are logarithmic in
the node count whatever the diameter, and no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, dense_ids
from arcweave.operators.contraction import component_links
from arcweave.operators.ranking import ranked
from arcweave.operators.spanning import spanning_forest
from arcweave.plans.materialize import discard, materialize, stat

#: Size of a root's subtree: it is above every node of its component.
ABOVE_ALL = 1 << 62


def rooted(tree: DataFrame) -> DataFrame:
    """(id, parent, pre, size) of the nodes of a forest (src, dst), rooted at each component's smallest node.

    ``pre`` are dense preorder numbers over all components: the subtree of a
    node is [pre, pre + size).  Roots have no parent.
    """
    both = tree.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e"))
    arcs = materialize(dense_ids(both, "e", "at").select("at", "e.u", "e.v"), "arcs")
    back = materialize(arcs.join(arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("at").alias("back")), ["u", "v"]), "back")
    spans = materialize(arcs.groupBy("u").agg(F.min("at").alias("first"), F.max("at").alias("last")), "spans")
    # the arc after (u, v) on the tour follows (v, u) in the circle of v's arcs
    ring = arcs.join(spans.select(F.col("last").alias("at"), "first"), "at", "left").select(F.col("at").alias("back"), F.coalesce("first", F.col("at") + 1).alias("next"))
    parts = materialize(component_links(tree, "src", "dst"), "trees")
    starts = parts.where("node = component").select(F.col("node").alias("u")).join(spans, "u").select(F.col("first").alias("next"), F.lit(True).alias("start"))
    tours = back.join(ring, "back").join(starts, "next", "left").select("at", F.when(F.col("start").isNull(), F.col("next")).alias("next"))
    d = ranked(tours)
    both_d = back.join(d, "at").join(d.select(F.col("at").alias("back"), F.col("d").alias("db")), "back")
    down = both_d.where("d > db").select(F.col("v").alias("id"), F.col("u").alias("parent"), ((F.col("d") - F.col("db") + 1) / 2).cast("long").alias("size"), "d")
    below = down.join(parts.withColumnRenamed("node", "id"), "id").select("id", "parent", "size", F.struct("component", (-F.col("d")).alias("o")).alias("key"))
    roots = parts.where("node = component").select(
        F.col("node").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(ABOVE_ALL).cast("long").alias("size"),
        F.struct("component", F.lit(-ABOVE_ALL).cast("long").alias("o")).alias("key"),
    )
    return materialize(dense_ids(below.unionByName(roots), "key", "pre").select("id", "parent", "pre", "size"), "rooted")


def _reached(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """``nodes`` but for roots with low and high, the least and largest of ``near`` (pre, lo, hi) over their subtrees."""
    own = nodes.join(near, "pre", "left").select(F.col("pre").alias("i"), F.least("pre", "lo").alias("lo"), F.greatest("pre", "hi").alias("hi"))
    asked = materialize(nodes.where("parent IS NOT NULL").withColumn("k", F.length(F.bin("size")) - 1), "asked", top=F.max("k"))
    state, out, top = materialize(own, "ranges"), None, stat(asked, "top")
    for k in range(top + 1):
        first, second = state.select(F.col("i").alias("pre"), "lo", "hi"), state.select(F.col("i").alias("end"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        at = asked.where(F.col("k") == k).withColumn("end", F.col("pre") + F.col("size") - (1 << k))
        found = materialize(at.join(first, "pre").join(second, "end").select("id", "parent", "pre", "size", F.least("lo", "lo2").alias("low"), F.greatest("hi", "hi2").alias("high")), "reached")
        out = found if out is None else out.unionByName(found)
        if k < top:
            shifted = state.select((F.col("i") - (1 << k)).alias("i"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            old, state = state, materialize(state.join(shifted, "i").select("i", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")), "ranges")
            discard(old)
    return out


def bridges_and_cuts(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(bridges (u, v) with u < v, articulation points (id)) of an undirected graph."""
    pairs = g.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    pairs = materialize(pairs.withColumn("w", F.lit(1).cast("long")), "pairs")
    tree = materialize(spanning_forest(Graph(g.nodes, pairs, False)).select("src", "dst"), "forest", n=F.count(F.lit(1)))
    if not stat(tree, "n"):
        return tree.select(F.col("src").alias("u"), F.col("dst").alias("v")), tree.select(F.col("src").alias("id"))
    nodes = rooted(tree)

    def end(of: str):
        return nodes.select(F.col("id").alias(of), F.col("pre").alias(f"{of}_pre"), F.col("size").alias(f"{of}_size"))

    extra = materialize(pairs.join(tree, ["src", "dst"], "left_anti").join(end("src"), "src").join(end("dst"), "dst"), "extra")
    ends = extra.select(F.explode(F.array(F.struct(F.col("src_pre").alias("pre"), F.col("dst_pre").alias("to")), F.struct(F.col("dst_pre").alias("pre"), F.col("src_pre").alias("to")))).alias("e")).select("e.*")
    known = materialize(_reached(nodes, ends.groupBy("pre").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))), "known")
    bridges = known.where("low >= pre AND high < pre + size").select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    # tree edges, named by their lower node, that share a cycle
    up = nodes.where("parent IS NOT NULL").select(F.col("id").alias("parent"), F.col("pre").alias("up_pre"), F.col("size").alias("up_size"))
    above = known.join(up, "parent").where("low < up_pre OR high >= up_pre + up_size").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    apart = "(dst_pre < src_pre OR dst_pre >= src_pre + src_size) AND (src_pre < dst_pre OR src_pre >= dst_pre + dst_size)"
    across = extra.where(apart).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    blocks = component_links(above.unionByName(across), "a", "b").withColumnRenamed("node", "id")
    named = known.join(blocks, "id", "left").select(F.explode(F.array("id", "parent")).alias("node"), F.coalesce("component", "id").alias("block"))
    cuts = named.groupBy("node").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b").select(F.col("node").alias("id"))
    return bridges, materialize(cuts, "cuts")
