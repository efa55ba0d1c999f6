"""Encoding sequences as they arrive, against a fixed reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqweave.operators.index import encode
from seqweave.schema import IndexConfig


def encode_stream(inputs: DataFrame, reference: DataFrame, config: IndexConfig, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the phrases of a stream (input_id, symbols) to Parquet. Inputs are independent, so no state is kept."""
    phrases = encode(inputs, reference, config).phrases
    return phrases.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
