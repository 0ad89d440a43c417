"""Scoring of streams: a model's transform is one projection, so it runs on a stream as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from coppice.estimators import ForestModel


def score_stream(model: ForestModel, rows: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Appends the scored rows of a stream to Parquet files, exactly once, until what is there is done."""
    if not rows.isStreaming:
        raise ValueError("not a stream")
    out = model.transform(rows).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
