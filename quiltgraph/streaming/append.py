"""Append ingestion: each micro-batch of entity columns becomes part of the graph.

A batch is written once, as Parquet beside the stream's checkpoint, and costs
what it holds: the graph reads its frame as it was, with the rows of the
batches in place of those of the same id, later batches before earlier ones.
Plans don't grow with the batches, and a graph that is opened again finds the
batches that ``compacted`` hasn't merged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiltgraph.graph import PropertyGraph
from quiltgraph.operators import lookup
from quiltgraph.sources import ingest

#: Where batches lie in a checkpoint, for nodes and edges.
FOLDERS = {"nodes": "batches-of-nodes", "edges": "batches-of-edges"}
BATCH = "_batch_number"


def append_edges(graph: PropertyGraph, stream: DataFrame, checkpoint: str, property_columns: Sequence[str] | None = None) -> StreamingQuery:
    """Upserts each batch's edges by id, so a batch that is run again after a failure changes nothing.

    Rows of one id in one batch are all kept. ``checkpoint`` is in a folder
    that all machines share.
    """
    return _appended(graph, "edges", lambda batch: ingest.edge_rows(batch, property_columns=property_columns), stream, checkpoint)


def append_nodes(graph: PropertyGraph, stream: DataFrame, checkpoint: str, property_columns: Sequence[str] | None = None) -> StreamingQuery:
    """Upserts each batch's nodes by id, as ``append_edges`` does edges."""
    return _appended(graph, "nodes", lambda batch: ingest.node_rows(batch, property_columns=property_columns), stream, checkpoint)


def compacted(graph: PropertyGraph, checkpoint: str) -> int:
    """Saves the graph with its batches as its next version, then removes them. Returns the version's number."""
    version = graph.save()
    for folder in FOLDERS.values():
        path, files = _at(graph, f"{checkpoint}/{folder}")
        files.delete(path, True)
    return version


def _appended(graph: PropertyGraph, entity: str, rows: Callable[[DataFrame], DataFrame], stream: DataFrame, checkpoint: str) -> StreamingQuery:
    folder = f"{checkpoint}/{FOLDERS[entity]}"
    base, seen, held, merged = getattr(graph, entity), None, [], set()

    def put(batch: DataFrame, number: int) -> None:
        rows(batch).withColumn(BATCH, F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{number:012d}")
        show()

    def show() -> None:
        nonlocal base, seen, held
        if seen is not None and getattr(graph, entity) is not seen:  # changed since by another hand
            base = getattr(graph, entity)
            merged.update(held)
        held = [p for p in _batches(graph, folder) if p not in merged]
        if held:
            latest = F.max(BATCH).over(W.partitionBy("id"))
            fresh = graph.spark.read.parquet(*held).withColumn("_latest", latest).where(F.col(BATCH) == F.col("_latest")).drop(BATCH, "_latest")
            graph.replaced(**{entity: lookup.upserted(base, fresh)})
        seen = getattr(graph, entity)

    show()
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _at(graph: PropertyGraph, name: str) -> tuple:
    path = graph.spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(graph.spark._jsc.hadoopConfiguration())


def _batches(graph: PropertyGraph, folder: str) -> list[str]:
    """The batches that were written to the end."""
    path, files = _at(graph, folder)
    if not files.exists(path):
        return []
    found = [f.getPath() for f in files.listStatus(path)]
    done = [p.toString() for p in found if files.exists(_at(graph, f"{p.toString()}/_SUCCESS")[0])]
    return sorted(done)
