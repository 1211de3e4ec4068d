"""Incremental loading with Structured Streaming: the checkpoint takes the place of a write-ahead log.

A micro-batch becomes a batch of the segment table under its own number.
Writing it again replaces it, so a replay after a crash neither loses nor
doubles rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skiplane.operators.layout import Layout
from skiplane.sources.segments import FIRST_STREAMED, SegmentTable


def ingest(stream: DataFrame, table: SegmentTable, layout: Layout, checkpoint: str) -> StreamingQuery:
    """Loads what is there and ends; call again, with the same checkpoint, for what came since. ``SegmentTable.compact`` joins the batches of a long stream."""

    def load(df: DataFrame, number: int) -> None:
        SegmentTable(df.sparkSession, table.path).write(df, layout, batch=FIRST_STREAMED + number)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
