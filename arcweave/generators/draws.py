"""Draws that don't depend on partitions or retries: hashes, jumps, and numbers without repeats."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.generators.classic import _ids
from arcweave.plans.materialize import materialize, stat


def uniform(seed: int, *what: Column) -> Column:
    """A number in [0, 1) for each combination of ``what``."""
    return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


#: Numbers drawn or handed on at a time.
CHUNK = 1 << 16


def chosen(rows: DataFrame, seed: int) -> DataFrame:
    """(src, run, k): of the numbers 0 .. m - 1 of each row (src, run, m, p) every one with probability p.

    Jumps from one chosen number to the next are geometric and drawn until they
    pass m, from a stream of (seed, src, run): the work follows what is chosen,
    nothing is cut off, and a task that runs again draws the same.
    """
    key = seed % (1 << 64)
    names = ["src", "run", "k"]

    def draw(batches):
        for batch in batches:
            held, size = [], 0
            for src, run, m, p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                r, at = np.random.default_rng((key, src, run)), -1
                while p > 0 and at < m - 1:
                    jumps = r.geometric(min(p, 1.0), min(CHUNK, int((m - at) * p) + 16))
                    got = at + np.cumsum(np.minimum(jumps, m + 1))
                    at = int(got[-1])
                    got = got[got < m]
                    held.append((np.full(len(got), src), np.full(len(got), run, dtype=np.int32), got.astype(np.int64)))
                    size += len(got)
                    if size >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

    typed = rows.selectExpr("CAST(src AS BIGINT) AS src", "CAST(run AS INT) AS run", "CAST(m AS BIGINT) AS m", "CAST(p AS DOUBLE) AS p")
    return typed.mapInArrow(draw, "src long, run int, k long")


def drawn(groups: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``groups`` (keys, m, p, others) with k: each of a group's numbers 0 .. m - 1 with the group's probability p, a row each.

    Numbers are cut into ranges of about ``CHUNK`` chosen ones, which are dealt
    over tasks, so one group of any size is drawn by many.
    """
    told = groups.where("m > 0 AND p > 0").withColumn("src", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 62)))
    told = materialize(told.withColumn("parts", F.greatest(F.ceil(F.col("m") * F.col("p") / CHUNK), F.lit(1)).cast("long")), "groups")
    size = F.expr("(m + parts - 1) div parts")
    ranges = told.select("src", "m", "p", size.alias("size"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("run"))
    ranges = ranges.select("src", "run", F.least("size", F.col("m") - F.col("run") * F.col("size")).alias("m"), "p")
    tasks = max(1, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = chosen(ranges.repartition(tasks, "src", "run"), seed)
    return told.withColumn("size_", size).join(found, "src").withColumn("k", F.col("k") + F.col("run") * F.col("size_")).drop("src", "run", "parts", "size_")


def around(n: str, k: str = "k") -> tuple[Column, Column]:
    """The two of ``n`` members that number ``k`` < n (n - 1) / 2 stands for: one, and one further round the circle."""
    return F.expr(f"{k} % {n}"), F.expr(f"({k} % {n} + 1 + {k} div {n}) % {n}")


def distinct_numbers(total: int, m: int, seed: int) -> DataFrame:
    """(k): ``m`` different numbers of 0 .. total - 1, every set of them as likely.

    Draws go on until m of them differ: each round draws as many as are missing,
    so none is ever too many.  Of more than half, those left out are drawn.
    """
    if 2 * m > total:
        return _ids(total).toDF("k").join(distinct_numbers(total, total - m, seed), "k", "left_anti")
    held, have, at = [_ids(0).toDF("k")], 0, 0
    while have < m:
        new = _ids(m - have).select(F.pmod(F.xxhash64(F.lit(seed), F.col("id") + F.lit(at)), F.lit(total)).alias("k")).distinct()
        new = materialize(new.join(reduce(DataFrame.union, held), "k", "left_anti") if have else new, "numbers", n=F.count("*"))
        at += m - have
        have += stat(new, "n")
        held.append(new)
    return reduce(DataFrame.union, held)
