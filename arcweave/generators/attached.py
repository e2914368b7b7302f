"""Models where a draw depends on earlier ones, as rounds over tables: growth by preference, rewired rings, stubs paired at random."""

from __future__ import annotations

import random
from bisect import bisect_right
from itertools import accumulate, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arcweave.generators.classic import _ids
from arcweave.generators.draws import around, uniform
from arcweave.model import dense_ids, edge_frame, node_frame
from arcweave.plans.materialize import discard, materialize, stat

#: Nodes grown one after the other before all others attach at once; at least eight times the edges of a node.
CORE = 1000


class NoGraph(ValueError):
    """The degrees can't be realised, or weren't in the tries allowed."""


def _core(n: int, m: int, seed: int) -> list[tuple[int, int]]:
    """The first ``n`` nodes: a clique of max(m, 2), then m different ends each, by degree."""
    r, first = random.Random(seed), min(n, max(m, 2))
    edges = [(u, v) for u in range(first) for v in range(u + 1, first)]
    ends = [x for e in edges for x in e]
    for u in range(first, n):
        got: set[int] = set()
        while len(got) < min(m, u):
            got.add(r.choice(ends))
        for v in sorted(got):
            edges.append((u, v))
            ends += [u, v]
    return edges


def preferential(n: int, m: int, seed: int) -> DataFrame:
    """(src, dst): ``m`` edges of every node to earlier ones by their degrees.

    Choosing by degree is choosing one of the edge ends written so far.  The
    ends of the core are known, an even place of a later edge is its new node,
    and an odd one is whatever that edge chose: a pointer, resolved for all
    edges at once by doubling.  An end that its node already has is drawn anew.
    """
    size = min(n, max(CORE, 8 * m))
    core = _core(size, m, seed)
    edges = edge_frame([(a, b, 1) for a, b in core]).select("src", "dst")
    if size == n:
        return edges
    fixed = 2 * len(core)
    ends = node_frame([(i, str(x)) for i, x in enumerate(x for e in core for x in e)]).select(F.col("id").alias("at"), F.col("data").cast("long").alias("known"))
    slots = _ids((n - size) * m).select(F.col("id").alias("slot"), F.expr(f"id div {m} + {size}").alias("src"), F.lit(0).alias("turn"))
    while True:
        placed = slots.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "slot", "turn"), F.lit(fixed) + (F.col("src") - size) * 2 * m))
        late = F.col("at") >= fixed
        edge, odd = F.expr(f"(at - {fixed}) div 2"), (F.col("at") - fixed) % 2 == 1
        # the core's ends are bounded by its size
        told = placed.join(F.broadcast(ends), "at", "left").select(
            "slot", "src", "turn",
            F.when(late & ~odd, F.expr(f"(at - {fixed}) div 2 div {m} + {size}")).otherwise(F.col("known")).alias("dst"),
            F.when(late & odd, edge).alias("points"),
        )
        state = materialize(told, "slots", open=F.count("points"))
        while stat(state, "open"):
            there = state.select(F.col("slot").alias("points"), F.col("dst").alias("found"), F.col("points").alias("on"))
            moved = state.where("points IS NOT NULL").drop("dst").join(there, "points").select("slot", "src", "turn", F.col("found").alias("dst"), F.col("on").alias("points"))
            old, state = state, materialize(state.where("points IS NULL").unionByName(moved), "slots", open=F.count("points"))
            discard(old)
        again = (F.row_number().over(Window.partitionBy("src", "dst").orderBy("slot")) > 1).cast("int")
        old, slots = state, materialize(state.withColumn("again", again).select("slot", "src", "dst", (F.col("turn") + F.col("again")).alias("turn"), "again"), "slots", again=F.sum("again"))
        discard(old)
        if not stat(slots, "again"):
            return edges.union(slots.select("src", "dst"))
        slots = slots.select("slot", "src", "turn")


#: Ends that a rewired edge draws in a round.
DRAWS = 8


def small_world(n: int, k: int, p: float, seed: int) -> DataFrame:
    """(src, dst): a ring of k / 2 neighbours each side; ends move with probability ``p`` to nodes that aren't neighbours.

    In each round every open edge draws ``DRAWS`` ends and takes the first whose
    pair is free; of several at one pair the lowest has it.  Pairs of the ring
    are free once their edge has moved.  Where a round places nothing, what is
    open stays on the ring, as it does at a node that all others are joined to.
    """
    ring = _ids(n * (k // 2)).select(F.col("id").alias("slot"), (F.col("id") % n).alias("src"), F.expr(f"(id % {n} + 1 + id div {n}) % {n}").alias("dst"))
    moves = uniform(seed, F.col("slot")) < p
    placed = ring.where(~moves)
    left = materialize(ring.where(moves), "open", n=F.count("*"))
    for turn in count():
        if not stat(left, "n"):
            break
        draws = F.array(*[F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64(F.lit(seed), "slot", F.lit(turn), F.lit(i)), F.lit(n - 1)).alias("x")) for i in range(DRAWS)])
        tried = left.select("slot", "src", F.explode(draws).alias("d")).select("slot", "src", "d.i", (F.col("d.x") + (F.col("d.x") >= F.col("src")).cast("long")).alias("dst"))
        pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
        free = tried.select("*", *pair).join(placed.union(left).select(*pair), ["a", "b"], "left_anti")
        first = free.groupBy("slot").agg(F.min(F.struct("i", "src", "dst", "a", "b")).alias("d")).select("slot", "d.*")
        won = first.groupBy("a", "b").agg(F.min(F.struct("slot", "src", "dst")).alias("d")).select("d.*")
        won = materialize(won, "moved", n=F.count("*"))
        if not stat(won, "n"):
            break
        placed = placed.union(won)
        old, left = left, materialize(left.join(won.select("slot"), "slot", "left_anti").select("slot", "src", "dst"), "open", n=F.count("*"))
        discard(old)
    return placed.union(left).select("src", "dst")


def _possible(degrees: DataFrame, loops: bool, multi: bool) -> bool:
    """Whether a graph has these degrees, from their histogram (its rows are as few as there are different degrees).

    Single edges without loops go by Erdos and Gallai, whose inequality is
    needed where equal degrees end only.
    """
    if loops:
        return True
    runs = [(r["degree"], r["n"]) for r in degrees.where("degree > 0").groupBy("degree").agg(F.count("*").alias("n")).orderBy(F.desc("degree")).collect()]
    if not runs:
        return True
    total = sum(d * n for d, n in runs)
    if multi:
        return 2 * runs[0][0] <= total
    nodes, sums = [0, *accumulate(n for _, n in runs)], [0, *accumulate(d * n for d, n in runs)]
    falling = [-d for d, _ in runs]
    for i in range(1, len(runs) + 1):
        k = nodes[i]
        # of the nodes after the first k, those of more than k count k each
        j = max(i, bisect_right(falling, -k - 1))
        if sums[i] > k * (k - 1) + k * (nodes[j] - k) + total - sums[j]:
            return False
    return True


#: Stubs listed from one row.
STUBS = 1 << 16


def paired(degrees: DataFrame, seed: int, loops: bool = False, multi: bool = False, tries: int = 100) -> DataFrame:
    """(src, dst), src <= dst: a graph of ``degrees`` (id, degree) from stubs in random order, two by two.

    Pairs that are loops or repeats where these aren't allowed go back, with
    twice as many of the pairs kept, chosen at random, and all those are paired
    again; after ``tries`` rounds :class:`NoGraph` is raised.  Where both are
    allowed one round does, and repeats stay.  A graph without either that has
    more than half of all pairs is made by its complement.
    """
    facts = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("total"), F.coalesce(F.min("degree"), F.lit(0)).alias("least"), F.count("*").alias("n")).first()
    if facts["least"] < 0 or facts["total"] % 2 or not _possible(degrees, loops, multi):
        raise NoGraph("no graph has these degrees")
    n = facts["n"]
    if not (loops or multi) and facts["total"] > n * (n - 1) // 2:
        ranked = dense_ids(degrees.select("id"), "id", "rank")
        pairs = _ids(n * (n - 1) // 2).toDF("k").select(*[c.alias(x) for c, x in zip(around(str(n)), "uv", strict=True)])
        for x, end in (("u", "a"), ("v", "b")):
            pairs = pairs.join(ranked.select(F.col("rank").alias(x), F.col("id").alias(end)), x)
        left_out = paired(degrees.select("id", (F.lit(n - 1) - F.col("degree")).alias("degree")), seed, tries=tries)
        return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).join(left_out, ["src", "dst"], "left_anti")
    ranges = degrees.where("degree > 0").select("id", "degree", F.explode(F.expr(f"sequence(0L, (degree - 1) div {STUBS})")).alias("c"))
    pool = ranges.select("id", F.explode(F.expr(f"sequence(c * {STUBS}, least(degree, (c + 1) * {STUBS}) - 1)")).alias("i"))
    kept = pool.select(F.col("id").alias("a"), "i", F.col("id").alias("b"), F.col("i").alias("j")).where("false")
    for turn in range(tries):
        key = F.struct(F.xxhash64(F.lit(seed), F.lit(turn), "id", "i").alias("h"), "id", "i")
        ranked = dense_ids(pool.withColumn("key", key), "key", "rank").groupBy(F.expr("rank div 2").alias("pair"))
        pairs = ranked.agg(F.min(F.struct("id", "i")).alias("x"), F.max(F.struct("id", "i")).alias("y"))
        pairs = materialize(pairs.select("pair", F.col("x.id").alias("a"), F.col("x.i").alias("i"), F.col("y.id").alias("b"), F.col("y.i").alias("j")), "pairs")
        fine = pairs if loops else pairs.where("a <> b")
        if not multi:
            once = fine.groupBy("a", "b").agg(F.min(F.struct("pair", "i", "j")).alias("x")).select("a", "b", "x.*")
            fine = once.join(kept.select("a", "b"), ["a", "b"], "left_anti") if turn else once
        fine = materialize(fine.select("pair", "a", "i", "b", "j"), "fine")
        bad = materialize(pairs.join(fine.select("pair"), "pair", "left_anti").select("a", "i", "b", "j"), "bad", n=F.count("*"))
        whole = materialize(kept.union(fine.select("a", "i", "b", "j")), "kept", n=F.count("*"))
        discard(kept, pool, pairs, fine)
        if not stat(bad, "n"):
            return whole.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        share = min(1.0, (2 * stat(bad, "n") + 2) / max(1, stat(whole, "n")))
        back = uniform(seed, F.lit(turn), F.col("a"), F.col("i"), F.col("b"), F.col("j")) < share
        ends = F.explode(F.array(F.struct(F.col("a").alias("id"), "i"), F.struct(F.col("b").alias("id"), F.col("j").alias("i")))).alias("s")
        pool = materialize(whole.where(back).union(bad).select(ends).select("s.*"), "stubs")
        kept = materialize(whole.where(~back), "kept")
        discard(whole, bad)
    raise NoGraph(f"no graph of these degrees in {tries} rounds")
