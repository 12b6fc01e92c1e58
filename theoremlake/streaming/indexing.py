"""Incremental indexing of a stream of declarations (X3): each trigger is an upsert of one batch into an Index, which writes
the buckets that the batch touches and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from theoremlake.operators.index import Index


def index_stream(declarations: DataFrame, index: Index, checkpoint: str, resume: bool = False, once: bool = True) -> StreamingQuery:
    """Start the query. A batch that is repeated after a failure changes nothing, as points are found by id."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.build(batch, resume=resume)

    writer = declarations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
