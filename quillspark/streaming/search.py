"""A stream of queries against a standing index, one batch of queries at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..retriever import Retriever


def search_stream(queries: DataFrame, retriever: Retriever, sink: Callable[[DataFrame, int], None], *, k: int = 10, checkpoint: str | None = None, once: bool = False) -> StreamingQuery:
    """Runs ``retriever`` on every micro-batch of the streaming ``queries(query_id, text)`` and hands the results
    and the batch number to ``sink``; a repeated batch has the same number, so sinks can be idempotent."""
    writer = queries.writeStream.foreachBatch(lambda batch, number: sink(retriever.retrieve(batch, k), number))
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
