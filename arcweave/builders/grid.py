"""Grids and grids that wrap around: cells are r * cols + c, edges weigh 1."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph, node_frame

Offsets = list[tuple[int, int]]
CanMove = Callable[[Column, Column], Column]

rook: Offsets = [(-1, 0), (0, -1), (0, 1), (1, 0)]
bishop: Offsets = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
queen: Offsets = rook + bishop
knight: Offsets = [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)]


def coord_to_id(r: int, c: int, cols: int) -> int:
    return r * cols + c


def id_to_coord(cell: int, cols: int) -> tuple[int, int]:
    return divmod(cell, cols)


def always(a: Column, b: Column) -> Column:
    return F.lit(True)


def avoiding(value: object) -> CanMove:
    return lambda a, b: (a != value) & (b != value)


def walkable(value: object) -> CanMove:
    return lambda a, b: (a == value) & (b == value)


def including(values: list) -> CanMove:
    return lambda a, b: a.isin(values) & b.isin(values)


def _gaps(a: int, b: int, cols: int) -> tuple[int, int]:
    (r, c), (s, d) = id_to_coord(a, cols), id_to_coord(b, cols)
    return abs(r - s), abs(c - d)


def _octile(x: int, y: int) -> float:
    return min(x, y) * math.sqrt(2) + (max(x, y) - min(x, y))


def manhattan_distance(a: int, b: int, cols: int) -> int:
    return sum(_gaps(a, b, cols))


def chebyshev_distance(a: int, b: int, cols: int) -> int:
    return max(_gaps(a, b, cols))


def octile_distance(a: int, b: int, cols: int) -> float:
    return _octile(*_gaps(a, b, cols))


def _wrapped_gaps(a: int, b: int, rows: int, cols: int) -> tuple[int, int]:
    x, y = _gaps(a, b, cols)
    return min(x, rows - x), min(y, cols - y)


def toroidal_manhattan_distance(a: int, b: int, rows: int, cols: int) -> int:
    return sum(_wrapped_gaps(a, b, rows, cols))


def toroidal_chebyshev_distance(a: int, b: int, rows: int, cols: int) -> int:
    return max(_wrapped_gaps(a, b, rows, cols))


def toroidal_octile_distance(a: int, b: int, rows: int, cols: int) -> float:
    return _octile(*_wrapped_gaps(a, b, rows, cols))


@dataclass(frozen=True)
class Grid:
    graph: Graph
    rows: int
    cols: int
    wraps: bool = False

    def to_graph(self) -> Graph:
        return self.graph

    def to_grid(self) -> Grid:
        return Grid(self.graph, self.rows, self.cols)

    def get_cell(self, r: int, c: int):
        """The payload, or None outside."""
        if not (0 <= r < self.rows and 0 <= c < self.cols):
            return None
        return self.graph.node(coord_to_id(r, c, self.cols))

    def find_node(self, predicate: Callable[[Column], Column]) -> int | None:
        """The smallest cell whose payload fits."""
        return self.graph.nodes.where(predicate(F.col("data"))).agg(F.min("id").alias("m")).first()["m"]


def from_cells(cells: DataFrame, rows: int, cols: int, offsets: Offsets = rook, can_move: CanMove = always, directed: bool = True, wraps: bool = False) -> Grid:
    """From a DataFrame (id, data): each cell's targets are arithmetic, one join brings their payloads."""
    r, c = F.expr(f"id div {cols}"), F.col("id") % cols
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
    at = cells.select("id", F.col("data").alias("here"), r.alias("r"), c.alias("c"), moves.alias("m"))
    y, x = F.col("r") + F.col("m.a"), F.col("c") + F.col("m.b")
    if wraps:
        y, x = F.pmod(y, F.lit(rows)), F.pmod(x, F.lit(cols))
    else:
        at = at.where((y >= 0) & (y < rows) & (x >= 0) & (x < cols))
    arcs = at.select(F.col("id").alias("src"), (y * cols + x).cast("long").alias("dst"), "here")
    there = cells.select(F.col("id").alias("dst"), F.col("data").alias("there"))
    arcs = arcs.join(there, "dst").where(can_move(F.col("here"), F.col("there"))).select("src", "dst")
    if not directed:
        arcs = arcs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = arcs.distinct().withColumn("w", F.lit(1).cast("long"))
    return Grid(Graph(cells, edges, directed), rows, cols, wraps)


def from_array_2d(cells: list[list], offsets: Offsets = rook, can_move: CanMove = always, directed: bool = True, wraps: bool = False) -> Grid:
    rows, cols = len(cells), len(cells[0]) if cells else 0
    frame = node_frame([(coord_to_id(r, c, cols), x) for r, row in enumerate(cells) for c, x in enumerate(row)])
    return from_cells(frame, rows, max(1, cols), offsets, can_move, directed, wraps)


def from_2d_list(cells: list[list], can_move: CanMove = always, directed: bool = True) -> Grid:
    return from_array_2d(cells, rook, can_move, directed)


def from_2d_list_with_topology(cells: list[list], offsets: Offsets, can_move: CanMove = always, directed: bool = True) -> Grid:
    return from_array_2d(cells, offsets, can_move, directed)


def toroidal_from_2d_list(cells: list[list], can_move: CanMove = always, directed: bool = True) -> Grid:
    return from_array_2d(cells, rook, can_move, directed, True)


def toroidal_from_2d_list_with_topology(cells: list[list], offsets: Offsets, can_move: CanMove = always, directed: bool = True) -> Grid:
    return from_array_2d(cells, offsets, can_move, directed, True)


toroidal_from_array_2d = toroidal_from_2d_list_with_topology
