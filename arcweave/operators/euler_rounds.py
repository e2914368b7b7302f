"""Euler tours as rows: pair the arcs at each vertex, merge the closed trails, rank the tour.

1. Every edge has two ends.  At each vertex the ends are paired in order of
   their numbers (an arc that comes in with one that leaves, if directed), so
   the edges fall into closed trails.  Undirected trails exist once in either
   direction; the one with the smaller end stays.
2. Trails that share a vertex are merged all at once: in the graph of trails
   and vertices a spanning forest is taken, and at each vertex the trails that
   the forest joins there exchange their next arcs in a circle.  In a forest no
   merge can undo another, so each component has one tour.
3. The tour starts at the component's smallest edge and is ranked by
   contraction of lists, in as many rounds as the logarithm of its length.

Places within a vertex are ranks of range partitions less the vertex's first,
so a vertex with very many edges is never gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, dense_ids
from arcweave.operators.contraction import component_links
from arcweave.operators.ranking import ranked
from arcweave.operators.spanning import spanning_forest
from arcweave.operators.transform import TooLarge
from arcweave.plans.materialize import discard, materialize, stat


def _places(rows: DataFrame, vertex: str, by: str) -> DataFrame:
    """``rows`` (``by`` unique) with ``place``: 0, 1, ... at each ``vertex`` in order of ``by``."""
    dense = dense_ids(rows.withColumn("_key", F.struct(vertex, by)), "_key", "_at")
    at = materialize(dense.drop("_key"), "places")
    discard(dense)
    first = at.groupBy(vertex).agg(F.min("_at").alias("_first"))
    return at.join(first, vertex).withColumn("place", F.col("_at") - F.col("_first")).drop("_at", "_first")


def _trails(edges: DataFrame, directed: bool) -> DataFrame:
    """(arc, u, v, next, edge): arcs that follow each other in closed trails over ``edges`` (edge, src, dst) with even or balanced vertices."""
    if directed:
        into = _places(edges.select("edge", F.col("dst").alias("v")), "v", "edge")
        out = _places(edges.select(F.col("edge").alias("next"), F.col("src").alias("v")), "v", "next")
        met = into.join(out, ["v", "place"]).select("edge", "next")
        return materialize(edges.join(met, "edge").select(F.col("edge").alias("arc"), F.col("src").alias("u"), F.col("dst").alias("v"), "next", "edge"), "trails")
    # end 2e leaves an edge's src and end 2e + 1 its dst; an arc is known by the end that it leaves
    ends = edges.select(F.explode(F.array(
        F.struct((F.col("edge") * 2).alias("arc"), F.col("src").alias("u"), F.col("dst").alias("v"), "edge"),
        F.struct((F.col("edge") * 2 + 1).alias("arc"), F.col("dst").alias("u"), F.col("src").alias("v"), "edge"),
    )).alias("x")).select("x.*")
    placed = materialize(_places(ends, "u", "arc"), "ends")
    pair = placed.select("u", F.floor(F.col("place") / 2).alias("pair"), (F.col("place") % 2).alias("half"), "arc")
    mates = pair.join(pair.select("u", "pair", (1 - F.col("half")).alias("half"), F.col("arc").alias("mate")), ["u", "pair", "half"]).select("arc", "mate")
    # an arc arrives at the other end of its edge and goes on from that end's mate
    following = mates.select(F.when(F.col("arc") % 2 == 0, F.col("arc") + 1).otherwise(F.col("arc") - 1).alias("arc"), F.col("mate").alias("next"))
    arcs = materialize(ends.join(following, "arc"), "arcs")
    ways = materialize(component_links(arcs, "arc", "next"), "ways")
    both = arcs.join(ways.withColumnRenamed("node", "arc"), "arc").select("arc", "u", "v", "next", "edge", "component")
    chosen = both.groupBy("edge").agg(F.min("component").alias("component"))
    trails = materialize(both.join(chosen, ["edge", "component"]).select("arc", "u", "v", "next", "edge"), "trails")
    discard(placed, arcs, ways)
    return trails


def _merged(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``arcs`` with ``next`` exchanged at vertices so that the trails of a component are one, and the (arc, component) of those.

    Only vertices where trails meet take part; where none do, trails are tours already.
    """
    trails = materialize(component_links(arcs, "arc", "next"), "trails")
    named = materialize(arcs.join(trails.withColumnRenamed("node", "arc"), "arc").withColumnRenamed("component", "trail"), "named")
    # one arc of each trail that comes into each vertex
    met = materialize(named.groupBy("v", "trail").agg(F.min("arc").alias("arc")), "met")
    several = met.groupBy("v").agg(F.count("*").alias("k")).where("k > 1")
    meets = materialize(met.join(several.select("v"), "v", "left_semi"), "meets", n=F.count("*"))
    discard(met)
    if not stat(meets, "n"):
        discard(named, meets)
        return arcs, trails.withColumnRenamed("node", "arc")
    crossing = Graph.from_frames(None, meets.select((F.col("v") * 2).alias("src"), (F.col("trail") * 2 + 1).alias("dst"), F.lit(1).cast("long").alias("w")), False)
    forest = spanning_forest(crossing).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    even = F.pmod(F.col("a"), F.lit(2)) == 0
    held = forest.select(F.floor(F.when(even, F.col("a")).otherwise(F.col("b")) / 2).alias("v"), F.floor(F.when(even, F.col("b")).otherwise(F.col("a")) / 2).alias("trail"))
    spots = materialize(_places(meets.join(held, ["v", "trail"]).select("v", "arc"), "v", "arc"), "spots")
    size = spots.groupBy("v").agg(F.count("*").alias("k"))
    turned = spots.join(size, "v").select("v", F.pmod(F.col("place") + 1, F.col("k")).alias("place"), "arc")
    given = turned.join(spots.select("v", "place", F.col("arc").alias("giver")), ["v", "place"]).select("arc", "giver")
    given = given.join(arcs.select(F.col("arc").alias("giver"), F.col("next").alias("new")), "giver").select("arc", "new")
    merged = materialize(named.join(given, "arc", "left").select("arc", "u", "v", F.coalesce("new", "next").alias("next"), "edge"), "merged")
    discard(arcs, trails, named, meets, spots)
    return merged, materialize(component_links(merged, "arc", "next").select(F.col("node").alias("arc"), "component"), "parts")


def euler_rows(edges: DataFrame, directed: bool) -> DataFrame:
    """(component, position, src, dst, edge): a tour over all edges of each component of ``edges`` (edge unique, src, dst).

    Every vertex must be even, or as often left as entered; otherwise a
    :class:`ValueError` says that there is no such tour.  Tours start with
    their component's smallest edge and are named by it; loops and parallel
    edges are walked like others.  Vertex and edge numbers are below 2 ** 62.
    """
    edges = materialize(edges.select("edge", "src", "dst"), "edges")
    gap = F.sum("x") if directed else F.sum(F.abs("x")) % 2
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("x")).union(edges.select("dst", F.lit(-1)))
    if not ends.groupBy("v").agg(gap.alias("gap")).where("gap <> 0").isEmpty():
        raise ValueError("some vertex is odd, or not left as often as it is entered")
    arcs, parts = _merged(_trails(edges, directed))
    placed = materialize(arcs.join(parts, "arc"), "placed")
    discard(arcs, parts)
    start = placed.groupBy("component").agg(F.min(F.struct("edge", "arc")).alias("x"), F.count("*").alias("n")).select("component", F.col("x.edge").alias("first"), F.col("x.arc").alias("next"), "n")
    cut = placed.join(start.select("next", F.lit(True).alias("last")), "next", "left")
    order = ranked(cut.select(F.col("arc").alias("at"), F.when(F.col("last").isNull(), F.col("next")).alias("next")))
    out = placed.join(order.withColumnRenamed("at", "arc"), "arc").join(start.select("component", "first", "n"), "component")
    out = materialize(out.select(F.col("first").alias("component"), (F.col("n") - 1 - F.col("d")).alias("position"), F.col("u").alias("src"), F.col("v").alias("dst"), "edge"), "tour")
    discard(edges, placed, order)
    return out


def euler_path_rows(edges: DataFrame, directed: bool) -> DataFrame:
    """As :func:`euler_rows` where each component may have one start and one end that are odd (or unbalanced by one).

    Such a component is closed by an edge of its own, which is taken out again:
    its path starts behind it.
    """
    edges = materialize(edges.select("edge", "src", "dst"), "edges")
    parts = materialize(component_links(edges, "src", "dst"), "parts")
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("x")).union(edges.select("dst", F.lit(-1)))
    odd = ends.groupBy("v").agg((F.sum("x") if directed else F.sum(F.abs("x")) % 2).alias("gap")).where("gap <> 0")
    odd = materialize(odd.join(parts.withColumnRenamed("node", "v"), "v"), "odd")
    pairs = odd.groupBy("component").agg(
        F.count("*").alias("k"), F.max(F.abs("gap")).alias("most"),
        (F.min(F.when(F.col("gap") > 0, F.col("v"))) if directed else F.min("v")).alias("start"), (F.max(F.when(F.col("gap") < 0, F.col("v"))) if directed else F.max("v")).alias("end"),
    )
    pairs = materialize(pairs, "pairs")
    if not pairs.where("k <> 2 OR most <> 1 OR start IS NULL OR `end` IS NULL").isEmpty():
        raise ValueError("some component has more than one start and one end")
    top = edges.agg(F.coalesce(F.max("edge"), F.lit(0)).alias("m")).first()["m"]
    closing = dense_ids(pairs.select("component", F.col("end").alias("src"), F.col("start").alias("dst")), "component", "i")
    closing = materialize(closing.select((F.col("i") + top + 1).alias("edge"), "src", "dst"), "closing")
    tours = euler_rows(edges.union(closing), directed)
    # where the closing edge lies, the path begins behind it; an undirected tour may walk it from start to end
    at = tours.join(closing.select("edge", F.col("src").alias("from_end")), "edge").select("component", F.col("position").alias("cut"), (F.col("src") != F.col("from_end")).alias("back"))
    sizes = tours.groupBy("component").agg(F.count("*").alias("n"))
    placed = tours.where(F.col("edge") <= top).join(sizes, "component").join(at, "component", "left")
    ahead = F.pmod(F.col("position") - F.col("cut") - 1, F.col("n"))
    turned = F.when(F.col("back"), F.col("n") - 2 - ahead).otherwise(ahead)
    return placed.select(
        "component", F.when(F.col("cut").isNull(), F.col("position")).otherwise(turned).alias("position"),
        F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "edge",
    )


def tours_exist(edges: DataFrame, directed: bool) -> tuple[bool, bool]:
    """(circuit, path): whether one walk over all of ``edges`` (src, dst) exists, closed or at all; neither without edges."""
    edges = materialize(edges.select("src", "dst"), "edges")
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("x")).union(edges.select("dst", F.lit(-1)))
    gap = F.sum("x") if directed else F.sum(F.abs("x")) % 2
    odd = ends.groupBy("v").agg(gap.alias("gap")).agg(F.count_if(F.col("gap") != 0).alias("odd"), F.max(F.abs("gap")).alias("most")).first()
    if component_links(edges, "src", "dst").select("component").distinct().limit(2).count() != 1:
        return False, False
    return odd["odd"] == 0, odd["odd"] == 0 or odd["odd"] == 2 and odd["most"] == 1


def listed(edges: DataFrame, directed: bool, closed: bool, max_edges: int) -> list | None:
    """The rows of the one tour over ``edges`` (edge, src, dst) in walking order, None if there is none; the result alone comes to the driver."""
    if not tours_exist(edges, directed)[0 if closed else 1]:
        return None
    rows = (euler_rows if closed else euler_path_rows)(edges, directed).limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise TooLarge(f"a tour of more than {max_edges} edges is not listed on the driver")
    return sorted(rows, key=lambda r: r["position"])
