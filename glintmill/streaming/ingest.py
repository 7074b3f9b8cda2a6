"""New documents, as they arrive, to chunks: packing is local to a document, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from glintmill.operators.segment import greedy_chunks


def chunk_stream(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Reads Parquet files of (doc_id, text) that appear in ``source``, appends their chunks to ``sink``, and ends when all are read."""
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)
    return greedy_chunks(docs).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
