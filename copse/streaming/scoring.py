"""Batch-fitted models over streaming frames: the same stateless scorers, valid in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, model, checkpoint: str, path: str | None = None, table: str | None = None) -> StreamingQuery:
    """Scores a streaming frame with model.transform and appends to Parquet files or a memory table."""
    w = model.transform(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return w.format("parquet").option("path", path).start() if path else w.format("memory").queryName(table).start()
