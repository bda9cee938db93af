"""Incremental synchronisation of a collection from a stream of chunk snapshots (an extra: no counterpart elsewhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.collection import Collection


def sync_stream(chunks: DataFrame, collection: Collection, embed, checkpoint: str):
    """Each micro-batch is a full list of a corpus's chunks; returns the query's writer."""
    return chunks.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else collection.sync(batch, embed)).option("checkpointLocation", checkpoint)
