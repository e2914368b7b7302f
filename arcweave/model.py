"""Graphs as pairs of DataFrames.

``nodes`` has (id BIGINT, data), ``edges`` has (src BIGINT, dst BIGINT, w).  An
undirected edge is stored once with src <= dst; :meth:`Graph.arcs` gives both
orientations (a loop once).  There is at most one edge per ordered pair (per
unordered pair if undirected); of repeated ones the last in input order wins.
Absence is an absent row, never a null or an infinity.

Every method is one lazy relational plan unless its docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Combine = Callable[[Column, Column], Column]


class MissingNode(ValueError):
    """An edge names a node that isn't there."""


def _spark() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a SparkSession is needed")
    return spark


def _kind(values: Iterable, default: T.DataType) -> T.DataType:
    for v in values:
        if v is None:
            continue
        if isinstance(v, bool):
            return T.BooleanType()
        if isinstance(v, int):
            return T.LongType()
        if isinstance(v, float):
            return T.DoubleType()
        if isinstance(v, str):
            return T.StringType()
        if isinstance(v, dict):
            return T.MapType(T.StringType(), T.StringType())
    return default


def node_frame(rows: Iterable[tuple[int, object]], data_type: T.DataType | None = None) -> DataFrame:
    rows = [(int(i), d) for i, d in rows]
    kind = data_type or _kind((d for _, d in rows), T.StringType())
    return _spark().createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("data", kind)]))


def edge_frame(rows: Iterable[tuple], weight_type: T.DataType | None = None) -> DataFrame:
    rows = [(int(r[0]), int(r[1]), r[2] if len(r) > 2 else None) for r in rows]
    kind = weight_type or _kind((w for *_, w in rows), T.LongType())
    if isinstance(kind, T.LongType) and any(isinstance(w, float) for *_, w in rows):
        kind = T.DoubleType()
    if isinstance(kind, T.DoubleType):
        rows = [(s, d, None if w is None else float(w)) for s, d, w in rows]
    fields = [T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("w", kind)]
    return _spark().createDataFrame(rows, T.StructType(fields))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the one with the largest ``order``; a partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys and c != order]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest])


def canonical(edges: DataFrame, directed: bool) -> DataFrame:
    if directed:
        return edges
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = True

    # ---- building

    @staticmethod
    def empty(directed: bool = True) -> Graph:
        return Graph(node_frame([]), edge_frame([]), directed)

    @staticmethod
    def from_frames(nodes: DataFrame | None, edges: DataFrame, directed: bool = True) -> Graph:
        """From frames whose edges are unique already; nodes default to the end points."""
        edges = canonical(edges, directed)
        if nodes is None:
            ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            nodes = ends.withColumn("data", F.lit(None).cast("string"))
        return Graph(nodes, edges, directed)

    @staticmethod
    def from_edges(edges: Iterable[tuple[int, int, object]], directed: bool = True) -> Graph:
        """From (src, dst, w), creating nodes; the last duplicate wins."""
        return Graph.empty(directed).add_edges_ensured(list(edges))

    @staticmethod
    def from_unweighted_edges(edges: Iterable[tuple[int, int]], directed: bool = True) -> Graph:
        return Graph.from_edges([(s, d, None) for s, d in edges], directed)

    @staticmethod
    def from_adjacency_list(rows: Iterable[tuple[int, list[tuple[int, object]]]], directed: bool = True) -> Graph:
        """From (src, [(dst, w)]); a source without neighbours is a node."""
        rows = list(rows)
        g = Graph.from_edges([(s, d, w) for s, near in rows for d, w in near], directed)
        return g.add_missing([s for s, _ in rows])

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(nodes, self.edges, self.directed)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, edges, self.directed)

    # ---- nodes

    def add_nodes_from(self, rows: Iterable[tuple[int, object]] | DataFrame) -> Graph:
        """Add or overwrite nodes; later ones win, edges stay."""
        new = rows if isinstance(rows, DataFrame) else node_frame(list(rows), self._data_type(rows))
        new = last_wins(new.withColumn("_at", F.monotonically_increasing_id()), ["id"], "_at")
        kept = self.nodes.join(new, "id", "left_anti")
        return self.with_nodes(kept.unionByName(new))

    def _data_type(self, rows) -> T.DataType | None:
        held = self.nodes.schema["data"].dataType
        found = _kind((d for _, d in rows), held)
        return held if type(found) is type(held) else found

    def add_node(self, node: int, data: object) -> Graph:
        return self.add_nodes_from([(node, data)])

    def add_nodes_from_keys(self, keys: Iterable[int], data: object = None) -> Graph:
        return self.add_nodes_from([(k, data) for k in keys])

    def add_missing(self, keys: Iterable[int], data: object = None) -> Graph:
        """Add those of ``keys`` that aren't nodes yet."""
        new = node_frame([(k, data) for k in dict.fromkeys(keys)], self.nodes.schema["data"].dataType)
        return self.with_nodes(self.nodes.unionByName(new.join(self.nodes, "id", "left_anti")))

    def remove_node(self, node: int) -> Graph:
        return Graph(self.nodes.where(F.col("id") != node), self.edges.where((F.col("src") != node) & (F.col("dst") != node)), self.directed)

    def has_node(self, node: int) -> bool:
        return not self.nodes.where(F.col("id") == node).isEmpty()

    def node(self, node: int):
        """The payload, or None."""
        row = self.nodes.where(F.col("id") == node).first()
        return None if row is None else row["data"]

    def all_nodes(self) -> DataFrame:
        return self.nodes.select("id").orderBy("id")

    def order(self) -> int:
        return self.nodes.count()

    node_count = order

    # ---- edges

    def _absent(self, rows: list[tuple]) -> str | None:
        """The message of the first edge that names an absent node."""
        ends = sorted({int(x) for r in rows for x in r[:2]})
        here = {r["id"] for r in self.nodes.where(F.col("id").isin(ends)).select("id").collect()}  # at most the given ends
        for s, d, *_ in rows:
            if s not in here and d not in here:
                return f"Nodes {s} and {d} do not exist"
            if s not in here:
                return f"Source node {s} does not exist"
            if d not in here:
                return f"Destination node {d} does not exist"
        return None

    def _upsert(self, rows: list[tuple]) -> DataFrame:
        new = canonical(edge_frame(rows).withColumn("_at", F.lit(0)), self.directed)
        held = self.edges.schema["w"].dataType
        wide = T.DoubleType() if {type(held), type(new.schema["w"].dataType)} == {T.LongType, T.DoubleType} else new.schema["w"].dataType
        if all(len(r) < 3 or r[2] is None for r in rows):
            wide = held
        new = canonical(edge_frame(rows, wide), self.directed).withColumn("_at", F.monotonically_increasing_id())
        new = last_wins(new, ["src", "dst"], "_at")
        kept = self.edges.join(new, ["src", "dst"], "left_anti").select("src", "dst", F.col("w").cast(wide).alias("w"))
        return kept.unionByName(new)

    def add_edges(self, rows: Iterable[tuple]) -> Graph:
        """Add or overwrite edges; raises :class:`MissingNode` for absent ends."""
        rows = list(rows)
        if not rows:
            return self
        if message := self._absent(rows):
            raise MissingNode(message)
        return self.with_edges(self._upsert(rows))

    def add_edge(self, src: int, dst: int, w: object = None) -> Graph:
        return self.add_edges([(src, dst, w)])

    def add_simple_edges(self, rows: Iterable[tuple[int, int]]) -> Graph:
        return self.add_edges([(s, d, 1) for s, d in rows])

    def add_unweighted_edges(self, rows: Iterable[tuple[int, int]]) -> Graph:
        return self.add_edges([(s, d, None) for s, d in rows])

    def try_add_edges(self, rows: Iterable[tuple]) -> tuple[Graph | None, str | None]:
        """(graph, None), or (None, message) of the first edge that fails."""
        rows = list(rows)
        message = self._absent(rows) if rows else None
        return (None, message) if message else (self.add_edges(rows), None)

    def try_add_edge(self, src: int, dst: int, w: object = None) -> tuple[Graph | None, str | None]:
        return self.try_add_edges([(src, dst, w)])

    def try_add_simple_edges(self, rows: Iterable[tuple[int, int]]) -> tuple[Graph | None, str | None]:
        return self.try_add_edges([(s, d, 1) for s, d in rows])

    def try_add_unweighted_edges(self, rows: Iterable[tuple[int, int]]) -> tuple[Graph | None, str | None]:
        return self.try_add_edges([(s, d, None) for s, d in rows])

    def add_edges_ensured(self, rows: Iterable[tuple], data: object = None) -> Graph:
        rows = list(rows)
        if not rows:
            return self
        g = self.add_missing([int(x) for r in rows for x in r[:2]], data)
        return g.with_edges(g._upsert(rows))

    def add_edge_ensured(self, src: int, dst: int, w: object = None, src_data: object = None, dst_data: object = None) -> Graph:
        return self.add_missing([src], src_data).add_missing([dst], dst_data).add_edge(src, dst, w)

    def add_edge_ensured_with(self, create: Callable[[int], object], src: int, dst: int, w: object = None) -> Graph:
        return self.add_edge_ensured(src, dst, w, create(src), create(dst))

    def add_edge_with_combine(self, src: int, dst: int, w: object, combine: Combine) -> Graph:
        """Add an edge; where there is one already, ``combine(existing, new)``."""
        if message := self._absent([(src, dst)]):
            raise MissingNode(message)
        key = canonical(edge_frame([(src, dst, w)]), self.directed)
        new = key.withColumnRenamed("w", "_new")
        both = self.edges.join(new, ["src", "dst"], "full_outer")
        value = F.when(F.col("_new").isNull(), F.col("w")).when(F.col("w").isNull(), F.col("_new")).otherwise(combine(F.col("w"), F.col("_new")))
        return self.with_edges(both.select("src", "dst", value.alias("w")))

    def try_add_edge_with_combine(self, src: int, dst: int, w: object, combine: Combine) -> tuple[Graph | None, str | None]:
        message = self._absent([(src, dst)])
        return (None, message) if message else (self.add_edge_with_combine(src, dst, w, combine), None)

    def remove_edge(self, src: int, dst: int) -> Graph:
        s, d = (src, dst) if self.directed else (min(src, dst), max(src, dst))
        return self.with_edges(self.edges.where(~((F.col("src") == s) & (F.col("dst") == d))))

    def arcs(self) -> DataFrame:
        """(src, dst, w) as seen from each node: both orientations if undirected, a loop once."""
        if self.directed:
            return self.edges.select("src", "dst", "w")
        turned = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        return self.edges.select("src", "dst", "w").unionByName(turned)

    def all_edges(self) -> DataFrame:
        return self.edges.orderBy("src", "dst")

    def edge_count(self) -> int:
        return self.edges.count()

    def has_edge(self, src: int, dst: int) -> bool:
        return not self.arcs().where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def edge_data(self, src: int, dst: int):
        row = self.arcs().where((F.col("src") == src) & (F.col("dst") == dst)).first()
        return None if row is None else row["w"]

    # ---- neighbourhoods

    def successors(self, node: int) -> DataFrame:
        return self.arcs().where(F.col("src") == node).select(F.col("dst").alias("id"), "w").orderBy("id")

    def predecessors(self, node: int) -> DataFrame:
        return self.arcs().where(F.col("dst") == node).select(F.col("src").alias("id"), "w").orderBy("id")

    def successor_ids(self, node: int) -> DataFrame:
        return self.successors(node).select("id")

    def predecessor_ids(self, node: int) -> DataFrame:
        return self.predecessors(node).select("id")

    def neighbor_frame(self) -> DataFrame:
        """(src, dst, w) of every node's neighbours; where both directions exist the outgoing weight."""
        if not self.directed:
            return self.arcs()
        both = self.edges.select("src", "dst", "w", F.lit(0).alias("_in")).unionByName(
            self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit(1).alias("_in"))
        )
        return both.groupBy("src", "dst").agg(F.min_by("w", "_in").alias("w"))

    def neighbors(self, node: int) -> DataFrame:
        return self.neighbor_frame().where(F.col("src") == node).select(F.col("dst").alias("id"), "w").orderBy("id")

    def neighbor_ids(self, node: int) -> DataFrame:
        return self.neighbors(node).select("id")

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree, degree) of every node; an undirected loop counts twice in ``degree``."""
        arcs = self.arcs()
        out = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("_loops"))
        into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
        zero = F.lit(0).cast("long")
        o, i = F.coalesce("out_degree", zero), F.coalesce("in_degree", zero)
        total = o + i if self.directed else o + F.coalesce("_loops", zero)
        return self.nodes.select("id").join(out, "id", "left").join(into, "id", "left").select(
            "id", o.alias("out_degree"), i.alias("in_degree"), total.alias("degree")
        )

    def _degree(self, node: int, column: str) -> int:
        arcs = self.arcs()
        row = arcs.where((F.col("src") == node) | (F.col("dst") == node)).agg(
            F.count_if(F.col("src") == node).alias("o"), F.count_if(F.col("dst") == node).alias("i"),
            F.count_if((F.col("src") == node) & (F.col("dst") == node)).alias("l"),
        ).first()
        return {"o": row["o"], "i": row["i"], "d": row["o"] + (row["i"] if self.directed else row["l"])}[column]

    def out_degree(self, node: int) -> int:
        return self._degree(node, "o")

    def in_degree(self, node: int) -> int:
        return self._degree(node, "i")

    def degree(self, node: int) -> int:
        return self._degree(node, "d")


def reduce_by(column: Column, order: Column, combine: Combine) -> Column:
    """``combine`` over a group's values in ``order``: an ordered fold inside an aggregate."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), column.alias("v"))))
    values = F.transform(rows, lambda x: x["v"])
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), combine)


#: Combines with an aggregate of their own, which sum up before the shuffle.
NATIVE = {"sum": F.sum, "min": F.min, "max": F.max}


def combined(column: str, combine: str | Combine, order: Column) -> Column:
    if isinstance(combine, str):
        return NATIVE[combine](column)
    return reduce_by(F.col(column), order, combine)


def dense_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ranks 0, 1, ... of ``column`` (unique) without gathering it in one task.

    Values are range-partitioned, counted by partition (one row each for the
    driver), and ranked within it from the partition's offset.
    """
    from arcweave.plans.materialize import materialize

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(df.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, at = {}, 0
    for p in sorted(counts):
        offsets[p], at = at, at + counts[p]
    table = [int(offsets.get(p, 0)) for p in range(max(offsets, default=0) + 1)]
    base = F.element_at(F.array(*map(F.lit, table)), F.col("_part") + 1).cast("long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    ranked = placed.withColumn(out, base + rank).drop("_part")
    ranked._written = placed._written  # for ``discard``
    return ranked
