"""Graphs as Python dictionaries, for algorithms that are sequential by nature.

A local graph is made either on the driver, behind a check of its size, or in
one task per connected component (``by_component``), so that many components
run side by side and no task holds more than ``max_edges`` edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.model import Graph
from arcweave.operators.transform import TooLarge

#: Edges that a local graph may have unless a caller says otherwise.
MAX_EDGES = 2_000_000


class Local:
    """Sorted adjacency of a small graph: ``out[u][v] = w`` and ``into[v][u] = w``."""

    def __init__(self, nodes: Iterable[int], edges: Iterable[tuple], directed: bool, data: dict | None = None):
        self.directed, self.data = directed, data or {}
        out = {n: {} for n in nodes}
        into = {n: {} for n in out}
        for s, d, w in edges:
            out.setdefault(s, {})[d] = w
            into.setdefault(d, {})[s] = w
            out.setdefault(d, {})
            into.setdefault(s, {})
            if not directed:
                out[d][s] = w
                into[s][d] = w
        order = sorted(out)
        self.out = {n: dict(sorted(out[n].items())) for n in order}
        self.into = {n: dict(sorted(into[n].items())) for n in order}
        self.nodes = order

    @classmethod
    def of(cls, g: Graph, max_edges: int = MAX_EDGES) -> Local:
        """``g`` on the driver; raises :class:`TooLarge` instead of collecting more than the bound."""
        edges = g.edges.select("src", "dst", "w").limit(max_edges + 1).collect()
        nodes = g.nodes.limit(max_edges + 1).collect()
        if len(edges) > max_edges or len(nodes) > max_edges:
            raise TooLarge(f"a sequential algorithm got more than {max_edges} nodes or edges")
        return cls([r["id"] for r in nodes], [(r["src"], r["dst"], r["w"]) for r in edges], g.directed, {r["id"]: r["data"] for r in nodes})

    def near(self, n: int) -> list[int]:
        """Neighbours in either direction, ascending."""
        return list(self.out[n]) if not self.directed else sorted({*self.out[n], *self.into[n]})

    def edges(self) -> list[tuple]:
        return [(u, v, w) for u in self.nodes for v, w in self.out[u].items() if self.directed or u <= v]

    def size(self) -> int:
        return len(self.edges())

    def without_loops(self) -> Local:
        return Local(self.nodes, [e for e in self.edges() if e[0] != e[1]], self.directed, self.data)

    def induced(self, keep: set[int]) -> Local:
        return Local([n for n in self.nodes if n in keep], [e for e in self.edges() if e[0] in keep and e[1] in keep], self.directed, self.data)

    def components(self) -> list[list[int]]:
        """Weakly connected components, by smallest node."""
        seen, out = set(), []
        for n in self.nodes:
            if n in seen:
                continue
            seen.add(n)
            todo, part = [n], []
            while todo:
                u = todo.pop()
                part.append(u)
                for v in (*self.out[u], *self.into[u]):
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
            out.append(sorted(part))
        return out


def by_component(g: Graph, kernel: Callable[[Local], Iterable[tuple]], schema: str, max_edges: int = MAX_EDGES, parts: DataFrame | None = None) -> DataFrame:
    """The rows that ``kernel`` gives for each weakly connected component, in one task each.

    Components are found by distributed rounds; one with more than ``max_edges``
    edges raises.  Isolated nodes are components of one node.  ``parts`` (id,
    component) are the components where a caller knows them.
    """
    from arcweave.operators.connectivity import weakly_connected_components
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    directed = g.directed
    parts = weakly_connected_components(g) if parts is None else parts
    edges = g.edges.join(parts.withColumnRenamed("id", "src"), "src").select("component", "src", "dst", F.col("w").cast("double").alias("w"), F.lit(True).alias("edge"))
    nodes = parts.select("component", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"), F.lit(False).alias("edge"))
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    whole = g.edges.schema["w"].dataType.simpleString() in ("bigint", "int")

    def run(table):
        rows = table.to_pylist()
        if len(rows) > 2 * max_edges:
            raise TooLarge(f"a component has more than {max_edges} edges")
        number = (lambda w: None if w is None else int(w)) if whole else (lambda w: w)
        local = Local([r["src"] for r in rows if not r["edge"]], [(r["src"], r["dst"], number(r["w"])) for r in rows if r["edge"]], directed)
        made = list(zip(*kernel(local), strict=True)) or [()] * len(arrow)
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return edges.unionByName(nodes).groupBy("component").applyInArrow(run, schema)
