"""Flows and cuts: push-relabel by rounds, other algorithms as kernels behind a size guard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators import kernels
from arcweave.operators.connectivity import weakly_connected_components
from arcweave.operators.contraction import component_links
from arcweave.operators.flow_rounds import max_flow_rows
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.transform import TooLarge
from arcweave.plans.materialize import discard, materialize, stat


@dataclass(frozen=True)
class MaxFlowResult:
    max_flow: object
    residual: list[tuple]
    source: int
    sink: int


@dataclass(frozen=True)
class MinCut:
    source_side: list[int]
    sink_side: list[int]


@dataclass(frozen=True)
class GlobalMinCut:
    weight: object
    group_a_size: int
    group_b_size: int


ALGORITHMS = {"edmonds_karp": kernels.edmonds_karp, "dinic": kernels.dinic, "push_relabel": kernels.push_relabel}


def max_flow(g: Graph, source: int, sink: int, algorithm: str = "dinic", max_edges: int = MAX_EDGES) -> MaxFlowResult:
    """The largest flow and all residual arcs (those of capacity 0 too)."""
    total, residual = ALGORITHMS[algorithm](Local.of(g, max_edges), source, sink)
    arcs = [] if source == sink else sorted((u, v, c) for u, near in residual.cap.items() for v, c in near.items())
    return MaxFlowResult(total, arcs, source, sink)


def edmonds_karp(g: Graph, source: int, sink: int) -> MaxFlowResult:
    return max_flow(g, source, sink, "edmonds_karp")


def dinic(g: Graph, source: int, sink: int) -> MaxFlowResult:
    return max_flow(g, source, sink, "dinic")


def push_relabel(g: Graph, source: int, sink: int, max_edges: int = MAX_EDGES) -> MaxFlowResult:
    """The flow of :func:`flow_rounds.max_flow_rows`; only its residual arcs, the result, come to the driver."""
    if source == sink:
        return MaxFlowResult(0, [], source, sink)
    found = max_flow_rows(g, source, sink)
    rows = found.residual.limit(2 * max_edges + 1).collect()
    if len(rows) > 2 * max_edges:
        raise TooLarge(f"a residual of more than {2 * max_edges} arcs is not listed on the driver")
    return MaxFlowResult(found.value, sorted((r["u"], r["v"], r["c"]) for r in rows), source, sink)


max_flow_int = max_flow_float = max_flow
edmonds_karp_int = edmonds_karp_float = edmonds_karp
dinic_int = dinic_float = dinic
push_relabel_int = push_relabel_float = push_relabel


def min_cut(result: MaxFlowResult) -> MinCut:
    """What the source still reaches in the residual graph, and the rest."""
    out: dict[int, list[int]] = {result.source: [], result.sink: []}
    for u, v, c in result.residual:
        out.setdefault(u, [])
        out.setdefault(v, [])
        if c > 0:
            out[u].append(v)
    seen, todo = {result.source}, [result.source]
    while todo:
        for v in out[todo.pop()]:
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return MinCut(sorted(seen), sorted(set(out) - seen))


#: Edges from which a graph is contracted before a kernel cuts it.
CUT_EDGES = 1_000


def global_min_cut(g: Graph, max_edges: int = MAX_EDGES, cut_edges: int = CUT_EDGES) -> GlobalMinCut:
    """The least cut of an undirected graph; of at most one node: the largest 32-bit weight, sizes 0.

    Larger graphs are contracted by rounds: the least degree bounds the cut, and
    no smaller cut parts the ends of an edge that weighs as much.  What is left
    when no edge does goes to the kernel, behind its guard.
    """
    edges = materialize(g.edges.where("src <> dst").select("src", "dst", "w"), "edges", n=F.count("*"), low=F.min("w"))
    if stat(edges, "n") < cut_edges or stat(edges, "low") < 0:
        weight, a, b = kernels.global_min_cut(Local.of(g, max_edges))
        return GlobalMinCut((1 << 31) - 1, 0, 0) if weight is None else GlobalMinCut(weight, a, b)
    parts = weakly_connected_components(g).groupBy("component").agg(F.count("*").alias("n"))
    one = parts.agg(F.count("*").alias("parts"), F.min(F.struct("component", "n")).alias("x"), F.sum("n").alias("n")).first()
    if one["parts"] > 1:
        return GlobalMinCut(0, one["x"]["n"], one["n"] - one["x"]["n"])
    n, best = one["n"], None
    sizes = materialize(g.nodes.select("id", F.lit(1).cast("long").alias("size")), "sizes")
    while True:
        degree = edges.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("d"))
        least = degree.agg(F.min(F.struct("d", "id")).alias("x")).select("x.*").first()
        if best is None or least["d"] < best[0]:
            size = sizes.where(F.col("id") == least["id"]).first()["size"]
            best = (least["d"], size, n - size)
        to = materialize(component_links(edges.where(F.col("w") >= best[0]), "src", "dst"), "to", n=F.count("*"))
        if not stat(to, "n"):
            break
        name = lambda c: to.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))  # noqa: E731, B023
        a, b = F.coalesce("src_to", "src"), F.coalesce("dst_to", "dst")
        met = edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left").select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "w")
        new = materialize(met.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges", n=F.count("*"))
        held = sizes.join(name("id"), "id", "left").groupBy(F.coalesce("id_to", "id").alias("id")).agg(F.sum("size").alias("size"))
        held = materialize(held, "sizes")
        discard(edges, sizes, to)
        edges, sizes = new, held
        if not stat(edges, "n"):
            return GlobalMinCut(*best)
    rest = Local.of(Graph(sizes.select("id", F.col("size").alias("data")), edges, False), max_edges)
    weight, a, b = kernels.global_min_cut(rest, rest.data)
    return GlobalMinCut(*(best if best[0] <= weight else (weight, a, b)))
