"""Streaming ingest: each micro-batch becomes one generation of the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.generation import GenerationStore


def stream_upserts(stream: DataFrame, root: str, table: str, key: Sequence[str], order: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream into a store table; within a batch the last row per key by ``order`` wins.

    A batch is appended as changes, in proportion to its rows, and merged when the
    table is read. A replayed batch has the same number and rows, so restarts do no harm.
    """

    def apply(batch: DataFrame, number: int) -> None:
        GenerationStore(batch.sparkSession, root).change(table, batch, key, order, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_orphans(edges: DataFrame, nodes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Edges of each micro-batch whose source is no node so far, as Parquet in one folder a batch; a replayed batch replaces its own."""
    sources = nodes.selectExpr("corpus_id", "node_id AS source_node_id").distinct()

    def apply(batch: DataFrame, number: int) -> None:
        batch.join(sources, ["corpus_id", "source_node_id"], "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
