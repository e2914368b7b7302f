"""Change logs as streams: each batch is applied to a graph kept as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.builders.live import apply_log
from arcweave.model import Graph
from arcweave.plans.materialize import new_path, remove
from arcweave.sources.files import write_text


class LiveGraph:
    """A graph that a stream of changes (seq, op, src, dst, label, w) keeps up to date.

    The state after a batch is a pair of tables in ``path/<batch id>``, complete
    once its ``done`` file is there.  A batch starts from the last complete state
    before it, so one that runs again, after a failure or a restart, isn't
    applied twice, and a restarted stream goes on from what is there.  The state
    that the last batch started from stays for that; others are deleted.
    """

    def __init__(self, start: Graph, path: str | None = None):
        self.first, self.graph, self.path, self.batches = start, start, path, 0

    def _complete(self) -> list[int]:
        """Batch ids of the complete states, ascending."""
        context = self.first.nodes.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path
        folder = at(self.path)
        fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(at(f"{self.path}/{n}/done")))

    def _load(self, batch_id: int) -> Graph:
        read = self.first.nodes.sparkSession.read
        nodes = read.schema(self.first.nodes.schema).parquet(f"{self.path}/{batch_id}/nodes")
        return Graph(nodes, read.schema(self.first.edges.schema).parquet(f"{self.path}/{batch_id}/edges"), self.first.directed)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.first.nodes.sparkSession
        self.path = self.path or new_path(spark, "live")
        held = self._complete()
        before = max((i for i in held if i < batch_id), default=None)
        g = apply_log(self.first if before is None else self._load(before), batch)
        here = f"{self.path}/{batch_id}"
        remove(spark, here)
        g.nodes.write.parquet(f"{here}/nodes")
        g.edges.write.parquet(f"{here}/edges")
        write_text("", f"{here}/done")
        for i in held:
            if i not in (before, batch_id):
                remove(spark, f"{self.path}/{i}")
        self.graph = self._load(batch_id)
        self.batches += 1

    def start(self, log: DataFrame, checkpoint: str, **trigger):
        """Run on a streaming DataFrame; returns the query.  Without a path of its own the graph is kept in ``checkpoint``."""
        self.path = self.path or f"{checkpoint.rstrip('/')}/graph"
        if held := self._complete():
            self.graph = self._load(held[-1])
        return log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def degree_stream(edges: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, id, degree) of a stream of edges (ts, src, dst) in event-time windows with a watermark."""
    ends = edges.withWatermark("ts", watermark).select("ts", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy(F.window("ts", window), "id").agg(F.count("*").alias("degree"))


def on_each(batch: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    return lambda df, _: batch(df)
