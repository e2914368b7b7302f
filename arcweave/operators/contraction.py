"""Connected components by contraction: every round merges vertices and leaves a graph of about half of them.

Each vertex moves to the least of its closed neighbourhood by a hash that is
new each round and one to one, so a hash stands for its vertex from then on and
nothing is ever mixed up.  Edges between the places moved to are the next
round's graph.  The work is that of the first rounds; what is left, at most
``REST`` edges whatever the input, is joined in one task, and names come back
through the moves from the last to the first.

An edge may carry a parity: whether its ends lie on different sides.  Moves add
parities up, and an edge within one vertex that is odd closes an odd cycle.

A round is a partial aggregate and two joins with one row a vertex, so the
edges of a hub stream past one row and Spark may split them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.plans.materialize import discard, materialize, stat

#: Edges that one task joins at the end.
REST = 100_000


def _mixed(c: str, round_: int) -> Column:
    """A one-to-one hash of 64-bit numbers: shifts and exclusive ors lose nothing."""
    x = F.col(c).bitwiseXOR(F.lit((0x9E3779B97F4A7C15 * (round_ + 1)) % (1 << 63)))
    for a, right, b in ((13, 7, 17), (21, 35, 4)):
        x = x.bitwiseXOR(F.shiftleft(x, a))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, right))
        x = x.bitwiseXOR(F.shiftleft(x, b))
    return x


def _joined(edges: DataFrame) -> DataFrame:
    """(rep, label, side, odd) of the few ``edges`` (u, v, p): their least vertex, the parity to it, whether a cycle is odd."""

    def work(batches):
        up: dict[int, int] = {}
        odd, bad = {}, set()

        def root(x):
            path, q = [], 0
            while up[x] != x:
                path.append(x)
                x = up[x]
            for y in reversed(path):
                q ^= odd[y]
                up[y], odd[y] = x, q
            return x

        for batch in batches:
            for u, v, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for x in (u, v):
                    if x not in up:
                        up[x], odd[x] = x, 0
                a, b = root(u), root(v)
                q = odd[u] ^ odd[v] ^ p
                if a == b:
                    if q:
                        bad.add(a)
                    continue
                if a > b:
                    a, b = b, a
                up[b], odd[b] = a, q
                if b in bad:
                    bad.add(a)
        ends = {x: root(x) for x in up}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(ends), pa.int64()), pa.array(list(ends.values()), pa.int64()), pa.array([odd[x] for x in ends], pa.int32()), pa.array([r in bad for r in ends.values()], pa.bool_())],
            names=["rep", "label", "side", "odd"],
        )

    return edges.select("u", "v", "p").coalesce(1).mapInArrow(work, "rep long, label long, side int, odd boolean")


def _moved(edges: DataFrame, round_: int, sided: bool) -> DataFrame:
    """(node, rep, q): where the vertices of ``edges`` move, and the parity between."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "p"))
    there, here = _mixed("v", round_), _mixed("u", round_)
    best = [F.min(there).alias("m")] + ([F.min_by("p", there).alias("q")] if sided else [])
    found = both.groupBy("u").agg(*best)
    q = F.when(F.col("m") < here, F.col("q")).otherwise(0).cast("int") if sided else F.lit(0)
    return found.select(F.col("u").alias("node"), F.least(here, F.col("m")).alias("rep"), q.alias("q"))


def contracted(links: DataFrame, u: str = "u", v: str = "v", sided: bool = False, rest: int = REST, max_rounds: int = 200) -> DataFrame:
    """(node, component, side, odd) for every node that occurs in ``links``; see :func:`component_links`.

    With ``sided`` every link joins opposite sides: ``side`` is 0 for the
    component's smallest node, and ``odd`` says that an odd cycle forbids sides.
    """
    links = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), F.lit(int(sided)).alias("p")).dropna()
    loop = F.col("u") == F.col("v")
    start = materialize(links, "links", n=F.count("*"), loops=F.count_if(loop))
    if stat(start, "n") <= rest:
        # the smallest vertex is the root there
        return materialize(_joined(start).select(F.col("rep").alias("node"), F.col("label").alias("component"), "side", "odd"), "components")
    edges, moves, held = start.where(~loop), [], None
    bad = start.where(loop).select(F.col("u").alias("node")).distinct()  # a loop is an odd cycle
    broken = []
    left = stat(start, "n") - stat(start, "loops")
    for round_ in range(max_rounds):
        if left <= rest:
            break
        to = materialize(_moved(edges, round_, sided), "moves")
        moves.append(to)
        end = lambda c: to.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep"), F.col("q").alias(f"{c}_q"))  # noqa: E731, B023
        met = edges.join(end("u"), "u").join(end("v"), "v")
        p = F.col("p").bitwiseXOR(F.col("u_q")).bitwiseXOR(F.col("v_q")) if sided else F.col("p")
        placed = met.select(F.greatest("u_rep", "v_rep").alias("u"), F.least("u_rep", "v_rep").alias("v"), p.alias("p"))
        placed = placed.where("u <> v OR p = 1" if sided else "u <> v").distinct()
        new = materialize(placed, "edges", n=F.count("*"), odd=F.count_if(loop))
        discard(held)
        held, left = new, stat(new, "n") - stat(new, "odd")
        if stat(new, "odd"):
            broken.append((round_, materialize(new.where(loop).select(F.col("u").alias("node")), "broken")))
        edges = new.where(~loop)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    names = _joined(edges)
    marks = dict(broken)
    for k in range(len(moves) - 1, -1, -1):
        if k in marks:
            # vertices of the round after this one that hold an odd cycle mark their component
            marked = marks[k].select(F.col("node").alias("rep"), F.lit(True).alias("mark"))
        back = moves[k].join(names, "rep", "left")
        odd = F.coalesce("odd", F.lit(False))
        if k in marks:
            back, odd = back.join(marked, "rep", "left"), odd | F.coalesce("mark", F.lit(False))
        side = F.col("q").bitwiseXOR(F.coalesce("side", F.lit(0))) if sided else F.lit(0)
        names = back.select(F.col("node").alias("rep"), F.coalesce("label", "rep").alias("label"), side.alias("side"), odd.alias("odd"))
    if stat(start, "loops"):
        looped = F.coalesce("looped", F.lit(False)) if sided else F.lit(False)
        names = names.join(bad.select(F.col("node").alias("rep"), F.lit(True).alias("looped")), "rep", "full_outer")
        names = names.select("rep", F.coalesce("label", "rep").alias("label"), F.coalesce("side", F.lit(0)).alias("side"), (F.coalesce("odd", F.lit(False)) | looped).alias("odd"))
    names = materialize(names, "names")
    own = [F.min("rep").alias("component")] + ([F.min_by("side", "rep").alias("first"), F.max("odd").alias("any")] if sided else [])
    named = names.join(names.groupBy("label").agg(*own), "label")
    side, odd = (F.col("side").bitwiseXOR(F.col("first")), F.col("any")) if sided else (F.col("side"), F.lit(False))
    out = named.select(F.col("rep").alias("node"), "component", side.alias("side"), odd.alias("odd"))
    out = materialize(out, "components")
    discard(start, held, names, *moves, *(b for _, b in broken))
    return out


def component_links(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that occurs in ``links``.

    The component is the smallest node reachable.  Nulls are ignored, loops
    give a component of one node, repeated links count once.
    """
    return contracted(links, u, v).select("node", "component")
