"""Centrality scores: (id, score) for every node.

Power iterations are joins with arcs that already carry their source's
out-degree and a partial aggregate per round.  Shortest-path centralities go
by blocks of sources over relational distances and path counts
(``shortest_counts``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators.local import MAX_EDGES, Local
from arcweave.operators.shortest_counts import dependencies, distance_sums
from arcweave.plans.materialize import materialize, stat


@dataclass(frozen=True)
class PageRankOptions:
    damping: float = 0.85
    max_iterations: int = 100
    tolerance: float = 0.0001


default_pagerank_options = PageRankOptions()


def degree(g: Graph, mode: str = "total") -> DataFrame:
    """Degree over n - 1; mode in, out or total (of no effect on undirected graphs)."""
    n = g.order()
    column = "degree" if not g.directed else {"in": "in_degree", "out": "out_degree", "total": "degree"}[mode]
    return g.degrees().select("id", (F.col(column) / F.lit(float(max(1, n - 1)))).alias("score"))


def degree_total(g: Graph) -> DataFrame:
    return degree(g, "total")


def per_source(g: Graph, kernel, schema: str, sources: DataFrame | None = None, max_edges: int = MAX_EDGES) -> DataFrame:
    """Rows of ``kernel(local, source)`` for every source, sources spread over tasks.

    The graph goes to the tasks as one broadcast, whose size ``max_edges``
    bounds; a larger graph raises and needs a relational way.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = g.nodes.sparkSession
    shared = spark.sparkContext.broadcast(Local.of(g, max_edges))
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def work(batches):
        for batch in batches:
            rows = [r for s in batch.column(0).to_pylist() for r in kernel(shared.value, s)]
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    ids = (g.nodes if sources is None else sources).select("id")
    return ids.repartition(max(1, spark.sparkContext.defaultParallelism * 2)).mapInArrow(work, schema)


def closeness(g: Graph) -> DataFrame:
    """(n - 1) / sum of distances; 0 unless every node is reached."""
    n = g.order()
    whole = (F.col("reached") == n) & (F.col("total") > 0) & F.lit(n > 1)
    return distance_sums(g).select("id", F.when(whole, (n - 1) / F.col("total")).otherwise(0.0).alias("score"))


closeness_int = closeness_float = closeness


def harmonic_centrality(g: Graph) -> DataFrame:
    """Sum of 1 / distance over n - 1."""
    n = g.order()
    return distance_sums(g).select("id", (F.col("inverse") / max(1, n - 1)).alias("score"))


harmonic_centrality_int = harmonic_centrality_float = harmonic_relational = harmonic_centrality


def betweenness(g: Graph, weighted: bool = True) -> DataFrame:
    """Sums over sources of shortest-path dependencies; halved if undirected. Weights must be above 0."""
    found = dependencies(g, weighted=weighted)
    share = 1.0 if g.directed else 0.5
    return g.nodes.select("id").join(found, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * share).alias("score"))


betweenness_int = betweenness_float = betweenness


def pagerank(g: Graph, options: PageRankOptions = default_pagerank_options) -> DataFrame:
    """Rank of a random surfer; sinks spread evenly. Stops by L1 change.

    Each round is one join of ranks with arcs and one partial aggregate; the
    sink mass and the change are sums over the nodes in the same table.
    """
    n = g.order()
    if not n:
        return g.nodes.select("id", F.lit(0.0).alias("score"))
    arcs = g.arcs().select("src", "dst")
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    start = g.nodes.select("id").join(out, "id", "left").select("id", F.lit(1.0 / n).alias("score"), F.coalesce("out", F.lit(0)).alias("out"))
    state, arcs = materialize(start, "ranks"), materialize(arcs, "arcs")
    d = options.damping
    sink = state.where("out = 0").agg(F.sum("score").alias("s")).first()["s"] or 0.0
    for _ in range(options.max_iterations):
        flow = arcs.join(state.where("out > 0").select(F.col("id").alias("src"), (F.col("score") / F.col("out")).alias("part")), "src")
        got = flow.groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        score = F.lit((1 - d) / n + d * sink / n) + F.lit(d) * F.coalesce("got", F.lit(0.0))
        new = materialize(
            state.join(got, "id", "left").select("id", score.alias("score"), "out", F.col("score").alias("old")), "ranks",
            change=F.sum(F.abs(F.col("score") - F.col("old"))), sink=F.sum(F.when(F.col("out") == 0, F.col("score"))),
        )
        state, sink = new.select("id", "score", "out"), stat(new, "sink") or 0.0
        if stat(new, "change") < options.tolerance:
            break
    return state.select("id", "score")


def _power(g: Graph, start, update, stop, max_iterations: int) -> DataFrame:
    """``update(got, old)`` of what each node gets from its predecessors, until ``stop(new)``."""
    arcs = materialize(g.arcs().select("src", "dst"), "arcs")
    state = materialize(g.nodes.select("id", start.alias("score")), "scores")
    gap = F.col("score") - F.col("old")
    for _ in range(max_iterations):
        got = arcs.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("got"))
        both = state.withColumnRenamed("score", "old").join(got, "id", "left").select("id", "old", F.coalesce("got", F.lit(0.0)).alias("got"))
        new = materialize(update(both), "scores", l1=F.sum(F.abs(gap)), l2=F.sqrt(F.sum(gap * gap)))
        done = stop(new)
        state = new.select("id", "score")
        if done:
            break
    return state


def _l1(new: DataFrame) -> float:
    return stat(new, "l1") or 0.0


def eigenvector(g: Graph, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration over predecessors, L2-normalised; 1 for a single node."""
    n = g.order()
    if n <= 1:
        return g.nodes.select("id", F.lit(1.0).alias("score"))

    def update(both):
        both = materialize(both, "got", norm=F.sqrt(F.sum(F.col("got") * F.col("got"))))
        norm = stat(both, "norm") or 0.0
        score = F.col("got") / norm if norm > 0 else F.lit(0.0)
        return both.select("id", score.alias("score"), "old")

    def stop(new):
        return stat(new, "l2") < tolerance

    return _power(g, F.lit(1.0 / math.sqrt(n)), update, stop, max_iterations)


def katz(g: Graph, alpha: float = 0.1, beta: float = 1.0, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """score = alpha * sum over predecessors + beta, from beta."""
    return _power(
        g, F.lit(float(beta)), lambda b: b.select("id", (F.lit(alpha) * F.col("got") + beta).alias("score"), "old"), lambda new: _l1(new) < tolerance, max_iterations
    )


def alpha_centrality(g: Graph, alpha: float = 0.1, initial: float = 1.0, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """score = alpha * sum over predecessors, from ``initial``."""
    return _power(
        g, F.lit(float(initial)), lambda b: b.select("id", (F.lit(alpha) * F.col("got")).alias("score"), "old"), lambda new: _l1(new) < tolerance, max_iterations
    )


def hits(g: Graph, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, hub, authority): hubs from the new authorities before those are normalised; both L2-normalised."""
    n = g.order()
    if not n:
        return g.nodes.select("id", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))
    arcs = materialize(g.arcs().select("src", "dst"), "arcs")
    state = materialize(g.nodes.select("id", F.lit(1 / math.sqrt(n)).alias("hub"), F.lit(1 / math.sqrt(n)).alias("authority")), "hits")
    for _ in range(max_iterations):
        a = arcs.join(state.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        a = materialize(a, "hits")
        h = arcs.join(a.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        new = state.join(a, "id", "left").join(h, "id", "left").select("id", "hub", "authority", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("a", F.lit(0.0)).alias("a"))
        new = materialize(new, "hits")
        norm = new.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("h"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("a")).first()
        hn, an = norm["h"] or 1.0, norm["a"] or 1.0
        row = new.agg(F.sum(F.abs(F.col("h") / hn - F.col("hub"))).alias("dh"), F.sum(F.abs(F.col("a") / an - F.col("authority"))).alias("da")).first()
        state = new.select("id", (F.col("h") / hn).alias("hub"), (F.col("a") / an).alias("authority"))
        if row["dh"] < tolerance and row["da"] < tolerance:
            break
    return state
