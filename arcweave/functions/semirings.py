"""Named semirings: how weights extend along a path and which path is best."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    """``extend`` continues a path by an edge, ``best`` is the aggregate over paths, ``better`` compares."""

    name: str
    start: object
    extend: Callable[[Column, Column], Column]
    best: Callable[[Column], Column]
    better: Callable[[Column, Column], Column]


MIN_PLUS = Semiring("min_plus", 0, lambda d, w: d + w, F.min, lambda a, b: a < b)
MAX_PLUS = Semiring("max_plus", 0, lambda d, w: d + w, F.max, lambda a, b: a > b)
MAX_MIN = Semiring("max_min", None, lambda d, w: F.least(d, w), F.max, lambda a, b: a > b)
MIN_MAX = Semiring("min_max", None, lambda d, w: F.greatest(d, w), F.min, lambda a, b: a < b)
