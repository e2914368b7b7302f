"""Components, cores and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.model import Graph
from arcweave.operators import blocks, kernels
from arcweave.operators.contraction import component_links
from arcweave.operators.local import MAX_EDGES, Local, by_component
from arcweave.operators.transform import induced, transitive_closure
from arcweave.plans.fixpoint import relax
from arcweave.plans.materialize import materialize, stat

#: Edges from which a component's bridges are found by rounds instead of in one task.
KERNEL_EDGES = 100_000


def weakly_connected_components(g: Graph) -> DataFrame:
    """(id, component): the smallest node reachable ignoring direction; distributed star rounds."""
    found = component_links(g.edges, "src", "dst").withColumnRenamed("node", "id")
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected_components(g: Graph) -> DataFrame:
    """Components of an undirected graph; a directed one has weak and strong ones instead."""
    if g.directed:
        raise ValueError("a directed graph has weakly or strongly connected components")
    return weakly_connected_components(g)


def _reach(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, color): the smallest label that reaches each node along ``arcs``; only improved rows spread."""
    start = labels.select("id", F.col("id").alias("color"), F.lit(True).alias("fresh"))

    def spread(fresh):
        return fresh.join(arcs, fresh["id"] == arcs["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("new"))

    def merged(state, new):
        better = F.coalesce(F.col("new") < F.col("color"), F.lit(False))
        return state.join(new, "id", "left").select("id", F.when(better, F.col("new")).otherwise(F.col("color")).alias("color"), better.alias("fresh"))

    state, settled = relax(materialize(start, "colors"), spread, merged, 10_000, "colors")
    if not settled:
        raise RuntimeError("colours did not settle")
    return state.select("id", "color")


def strongly_connected_components(g: Graph, max_rounds: int = 1000) -> DataFrame:
    """(id, component): the smallest node of each strongly connected component.

    Distributed: nodes that have no way in or out are trimmed; the rest take
    the smallest node that reaches them as colour, and what reaches the colour's
    node back within the colour is its component.
    """
    arcs = materialize(g.arcs().where("src <> dst").select("src", "dst").distinct(), "arcs")
    left = materialize(g.nodes.select("id"), "left")
    done = None
    for _ in range(max_rounds):
        while True:
            keep = left.join(arcs.select(F.col("src").alias("id")), "id", "left_semi").join(arcs.select(F.col("dst").alias("id")), "id", "left_semi")
            keep = materialize(keep, "left")
            single = materialize(left.join(keep, "id", "left_anti").select("id", F.col("id").alias("component")), "single", n=F.count(F.lit(1)))
            if not stat(single, "n"):
                break
            done = single if done is None else done.unionByName(single)
            left = keep
            a = arcs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi")
            arcs = materialize(a.select("src", "dst"), "arcs")
        if left.isEmpty():
            return done if done is not None else g.nodes.select("id", F.col("id").alias("component"))
        colors = materialize(_reach(arcs, left), "colors")
        s, d = colors.select(F.col("id").alias("src"), F.col("color").alias("cs")), colors.select(F.col("id").alias("dst"), F.col("color").alias("cd"))
        within = materialize(arcs.join(s, "src").join(d, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "within")
        from arcweave.operators.traversal import levels

        back = levels(within, colors.where("id = color").select("id"))
        part = materialize(back.join(colors, "id").select("id", F.col("color").alias("component")), "part")
        done = part if done is None else done.unionByName(part)
        left = materialize(left.join(part, "id", "left_anti"), "left")
        a = arcs.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi")
        arcs = materialize(a.select("src", "dst"), "arcs")
    raise RuntimeError("strong components did not settle")


def strong_components_lists(g: Graph, max_edges: int = MAX_EDGES) -> list[list[int]]:
    """Strongly connected components in reverse topological order (one kernel)."""
    return kernels.strong_components(Local.of(g, max_edges))


def kosaraju(g: Graph, max_edges: int = MAX_EDGES) -> list[list[int]]:
    """The same partition, in topological order."""
    return strong_components_lists(g, max_edges)[::-1]


def analyze(g: Graph, max_edges: int = KERNEL_EDGES) -> tuple[DataFrame, DataFrame]:
    """(bridges (u, v), articulation points (id)) of an undirected graph.

    Components of fewer than ``max_edges`` edges take a task each; larger ones
    go by relational rounds, whatever their size.
    """
    if g.directed:
        raise ValueError("bridges are those of undirected graphs")

    def kernel(local):
        bridges, cuts = kernels.bridges_and_cuts(local)
        yield from (("bridge", u, v) for u, v in bridges)
        yield from (("cut", n, None) for n in cuts)

    parts = materialize(weakly_connected_components(g), "components")
    placed = g.edges.join(parts.withColumnRenamed("id", "src"), "src")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    large = materialize(sizes.where(F.col("n") >= max_edges).select("component"), "large", n=F.count(F.lit(1)))
    small = g
    if stat(large, "n"):
        small = Graph(
            g.nodes.join(parts.join(large, "component", "left_anti").select("id"), "id", "left_semi"),
            placed.join(large, "component", "left_anti").select("src", "dst", "w"), False,
        )
        parts = parts.join(large, "component", "left_anti").select("id", "component")
    found = materialize(by_component(small, kernel, "kind string, u long, v long", max_edges, parts), "bridges")
    bridges, cuts = found.where("kind = 'bridge'").select("u", "v"), found.where("kind = 'cut'").select(F.col("u").alias("id"))
    if stat(large, "n"):
        more = blocks.bridges_and_cuts(Graph(g.nodes, placed.join(large, "component", "left_semi").select("src", "dst", "w"), False))
        bridges, cuts = bridges.unionByName(more[0]), cuts.unionByName(more[1])
    return bridges, cuts


def core_numbers(g: Graph, max_rounds: int = 10_000) -> DataFrame:
    """(id, core) of an undirected graph by rounds of the h-index of neighbours' estimates.

    Estimates start at the degree (a loop counts once) and only fall; each
    round is a join and an aggregate.
    """
    if g.directed:
        raise ValueError("core numbers are those of undirected graphs")
    arcs = materialize(g.arcs().select("src", "dst"), "arcs")
    degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core"))
    state = materialize(g.nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core")), "cores")
    for _ in range(max_rounds):
        # neighbours are counted by value, not listed: the h-index is the largest least(value, how many reach it)
        s, d = state.select(F.col("id").alias("src"), F.col("core").alias("own")), state.select(F.col("id").alias("dst"), "core")
        counts = arcs.join(d, "dst").join(s, "src").groupBy(F.col("src").alias("id"), F.least("core", "own").alias("v")).agg(F.count("*").alias("n"))
        reach = F.sum("n").over(Window.partitionBy("id").orderBy(F.col("v").desc()))
        near = counts.select("id", F.least("v", reach).alias("h")).groupBy("id").agg(F.max("h").alias("h"))
        new = materialize(state.join(near, "id", "left").select("id", "core", F.least("core", F.coalesce("h", F.lit(0).cast("long"))).alias("new")), "cores", moved=F.count_if(F.col("new") < F.col("core")))
        moved = stat(new, "moved")
        state = new.select("id", F.col("new").alias("core"))
        if not moved:
            return state
    raise RuntimeError("core numbers did not settle")


def k_core(g: Graph, k: int) -> Graph:
    return induced(g, core_numbers(g).where(F.col("core") >= k))


def degeneracy(g: Graph) -> int:
    return core_numbers(g).agg(F.max("core").alias("m")).first()["m"] or 0


def shell_decomposition(g: Graph) -> DataFrame:
    """(core, id)."""
    return core_numbers(g).select("core", "id")


def reachability_counts(g: Graph, direction: str = "descendants") -> DataFrame:
    """(id, n): how many other nodes each reaches (descendants) or is reached by (ancestors)."""
    closed = transitive_closure(g.with_edges(g.edges.withColumn("w", F.lit(1).cast("long")))).arcs().where("src <> dst")
    end = "src" if direction == "descendants" else "dst"
    counts = closed.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    return g.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def reachability_estimate(g: Graph, direction: str = "descendants", bits: int = 10, max_rounds: int = 10_000) -> DataFrame:
    """(id, n): estimates by sketches of ``2 ** bits`` registers that merge along arcs until none grows."""
    arcs = g.arcs() if direction == "descendants" else g.arcs().select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    arcs = materialize(arcs.where("src <> dst").select("src", "dst"), "arcs")
    state = materialize(g.nodes.groupBy("id").agg(F.hll_sketch_agg("id", F.lit(bits)).alias("s")).withColumn("e", F.hll_sketch_estimate("s")), "sketch")
    for _ in range(max_rounds):
        got = arcs.join(state.select(F.col("id").alias("dst"), "s"), "dst").select(F.col("src").alias("id"), "s")
        both = got.unionByName(state.select("id", "s")).groupBy("id").agg(F.hll_union_agg("s").alias("s"))
        new = materialize(both.withColumn("e", F.hll_sketch_estimate("s")).join(state.select("id", F.col("e").alias("old")), "id"), "sketch")
        moved = not new.where("e > old").isEmpty()
        state = new.select("id", "s", "e")
        if not moved:
            break
    return state.select("id", F.greatest(F.col("e") - 1, F.lit(0)).alias("n"))
