"""Ranking of linked lists by contraction: every round takes out a third of the rows, none of them neighbours.

A row whose hash is above both neighbours' leaves, and its predecessor takes
over its link.  Its rank is that of its successor and the length of its own
link, so ranks come back from the last round to the first.  All rounds together
handle a few times the rows, where pointer doubling handles all rows in each;
the last rows, at most ``REST`` whatever the input, are walked in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.contraction import REST
from arcweave.plans.materialize import discard, materialize, stat


def _walked(rows: DataFrame) -> DataFrame:
    """(at, r) of the few ``rows`` (at, next, d)."""

    def work(batches):
        link = {}
        for batch in batches:
            link.update(zip(batch.column(0).to_pylist(), zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), strict=True))
        rank: dict[int, int] = {}
        for start in link:
            path, x = [], start
            while x is not None and x not in rank:
                path.append(x)
                x = link[x][0]
                if len(path) > len(link):
                    raise ValueError("a list runs in a circle")
            r = 0 if x is None else rank[x]
            for y in reversed(path):
                r += link[y][1]
                rank[y] = r
        yield pa.RecordBatch.from_arrays([pa.array(list(rank), pa.int64()), pa.array(list(rank.values()), pa.int64())], names=["at", "r"])

    return rows.select("at", "next", "d").coalesce(1).mapInArrow(work, "at long, r long")


def ranked(links: DataFrame, rest: int = REST, max_rounds: int = 500) -> DataFrame:
    """(at, d): how many rows follow each of ``links`` (at, next; null at a list's end), each followed once at most."""
    start = materialize(links.select(F.col("at").cast("long").alias("at"), F.col("next").cast("long").alias("next"), F.col("next").isNotNull().cast("long").alias("d")), "list", n=F.count("*"))
    if stat(start, "n") <= rest:
        out = materialize(_walked(start).withColumnRenamed("r", "d"), "ranks")
        discard(start)
        return out
    before = start.where("next IS NOT NULL").select(F.col("next").alias("at"), F.col("at").alias("prev"))
    rows = materialize(start.join(before, "at", "left").select("at", "prev", "next", "d"), "list", n=F.count("*"))
    discard(start)
    gone, n = [], stat(rows, "n")
    for round_ in range(max_rounds):
        if n <= rest:
            break
        toss = lambda c: F.xxhash64(F.lit(round_), F.col(c))  # noqa: E731, B023
        above = lambda c: F.col(c).isNull() | (toss("at") > toss(c))  # noqa: E731, B023
        # ends of lists stay unless their list is longer than themselves
        leaves = F.col("prev").isNotNull() & F.col("next").isNotNull() & above("prev") & above("next")
        told = rows.withColumn("leaves", leaves)
        out = materialize(told.where("leaves").select("at", "prev", "next", "d"), "gone", n=F.count("*"))
        ahead = out.select(F.col("prev").alias("at"), F.col("next").alias("then"), F.col("d").alias("more"))
        back = out.select(F.col("next").alias("at"), F.col("prev").alias("former"))
        kept = told.where("NOT leaves").join(ahead, "at", "left").join(back, "at", "left")
        new = kept.select("at", F.coalesce("former", "prev").alias("prev"), F.coalesce("then", "next").alias("next"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
        # lists of one or two rows have nothing to take out: they are done
        new = materialize(new, "list", n=F.count("*"), open=F.count_if(F.col("prev").isNotNull() & F.col("next").isNotNull()))
        discard(rows)
        rows, n = new, stat(new, "n")
        gone.append(out)
        if not stat(new, "open"):
            break
    else:
        raise RuntimeError(f"lists were not ranked in {max_rounds} rounds")
    if n <= rest:
        ranks = _walked(rows)
    else:
        # every list is down to its first and last row
        ranks = rows.select("at", F.col("d").alias("r"))
    ranks = materialize(ranks, "ranks")
    discard(rows)
    for out in reversed(gone):
        found = out.join(ranks.select(F.col("at").alias("next"), "r"), "next").select("at", (F.col("r") + F.col("d")).alias("r"))
        old, ranks = ranks, materialize(ranks.unionByName(found), "ranks")
        discard(old, out)
    named = ranks.select("at", F.col("r").alias("d"))
    named._written = ranks._written  # for ``discard``
    return named
