"""Fixpoint loops: relational rounds with lineage cut in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.materialize import discard, materialize, stat


def relax(state: DataFrame, spread: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], rounds: int, name: str = "relax") -> tuple[DataFrame, bool]:
    """Semi-naive rounds: only rows marked ``fresh`` spread; (state, settled).

    ``spread`` makes proposals of the fresh rows, ``merge(state, proposals)``
    the next state with ``fresh`` on what improved.
    """
    written, left = None, None
    for _ in range(rounds):
        fresh = state.where("fresh")
        if left == 0 or left is None and fresh.isEmpty():
            return state, True
        old, written = written, materialize(merge(state, spread(fresh)), name, fresh=F.count_if("fresh"))
        discard(old)
        state, left = written, stat(written, "fresh")
    return state, left == 0
