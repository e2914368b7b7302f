"""Disjoint sets as a DataFrame (elem, comp); comp is the smallest element."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import node_frame
from arcweave.operators.contraction import component_links


@dataclass(frozen=True)
class DisjointSet:
    frame: DataFrame

    @staticmethod
    def empty() -> DisjointSet:
        return DisjointSet(node_frame([]).select(F.col("id").alias("elem"), F.col("id").alias("comp")))

    @staticmethod
    def from_pairs(pairs: DataFrame | Iterable[tuple[int, int]]) -> DisjointSet:
        """Sets joined by ``pairs`` (x, y), all at once."""
        if not isinstance(pairs, DataFrame):
            pairs = node_frame([(x, str(y)) for x, y in pairs]).select(F.col("id").alias("x"), F.col("data").cast("long").alias("y"))
        return DisjointSet(component_links(pairs, "x", "y").select(F.col("node").alias("elem"), F.col("component").alias("comp")))

    def add(self, elem: int) -> DisjointSet:
        new = node_frame([(elem, None)]).select(F.col("id").alias("elem"), F.col("id").alias("comp"))
        return DisjointSet(self.frame.unionByName(new.join(self.frame, "elem", "left_anti")))

    def find(self, elem: int) -> tuple[DisjointSet, int]:
        """(sets, the element's set); an unknown element is added."""
        row = self.frame.where(F.col("elem") == elem).first()
        return (self, row["comp"]) if row else (self.add(elem), elem)

    def union(self, x: int, y: int) -> DisjointSet:
        s, a = self.find(x)
        s, b = s.find(y)
        if a == b:
            return s
        return DisjointSet(s.frame.select("elem", F.when(F.col("comp") == max(a, b), F.lit(min(a, b))).otherwise(F.col("comp")).cast("long").alias("comp")))

    def connected(self, x: int, y: int) -> bool:
        return self.find(x)[1] == self.find(y)[1]

    def size(self) -> int:
        return self.frame.count()

    def count_sets(self) -> int:
        return self.frame.select("comp").distinct().count()

    def to_lists(self) -> DataFrame:
        """(comp, members)."""
        return self.frame.groupBy("comp").agg(F.array_sort(F.collect_list("elem")).alias("members"))
