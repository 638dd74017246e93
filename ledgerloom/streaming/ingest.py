"""Streaming ingest: an addition; each micro-batch goes through the batch check against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.dedup import check_candidates, ingest


def ingest_stream(candidates: DataFrame, ledger: DataFrame, rejected: DataFrame, queue_path: str, checkpoint: str) -> StreamingQuery:
    """Append accepted candidates to the queue at queue_path; later batches see earlier ones there. A replayed batch finds its rows stored and adds none."""
    columns = candidates.columns

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            queue = spark.read.schema(candidates.schema).parquet(queue_path)
        except Exception as e:  # nothing is stored before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            queue = spark.createDataFrame([], candidates.schema)
        ingest(check_candidates(batch, ledger, queue, rejected))[0].select(columns).write.mode("append").parquet(queue_path)

    return candidates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
