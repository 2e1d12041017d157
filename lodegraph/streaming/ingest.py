"""Relationships and nodes from a stream, committed to a stored graph batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def edge_sink(stream: DataFrame, store: Store, kind: str, checkpoint: str) -> StreamingQuery:
    """Write rows ``(src, dst, properties...)`` as relationships of one type; both ends must be nodes of the graph.

    A relationship that is there already stays one, so a batch that is run again after a failure changes nothing.
    """

    def commit(batch: DataFrame, _: int) -> None:
        rows = batch.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).persist()
        try:
            if not rows.isEmpty():
                with store.begin() as t:
                    t.edge_frames.append((kind, rows))
                    t.commit()
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).start()
