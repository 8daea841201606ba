"""Streams: documents validated as they arrive, the rejected ones to a place of their own.

Validation keeps no state, so the same narrow pass serves batch and stream, without watermark or shuffle.
Rates over time are an addition: they count by event-time window, with a watermark that bounds their state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import ERRORS, INVALID, split_valid, validate_documents


def quarantine(stream: DataFrame, doc_col: str, schema, accepted: str, rejected: str, checkpoint: str, tier: str = "auto", available_now: bool = True) -> StreamingQuery:
    """Writes valid documents to one folder and rejected ones, with their errors and messages, to another.

    Each batch is written under its own number, so a batch that is run again replaces what it wrote.
    """
    validated = validate_documents(stream, doc_col, schema, tier, messages=True)

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        good, bad = split_valid(kept)
        good.drop(ERRORS, INVALID).write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        kept.unpersist()

    writer = validated.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rejection_rates(validated: DataFrame, time_col: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, n_documents, n_rejected) by event-time window."""
    timed = validated.withWatermark(time_col, late) if validated.isStreaming else validated
    bad = (F.col(INVALID) | (F.size(ERRORS) > 0)).cast("bigint")
    counted = timed.groupBy(F.window(time_col, width).alias("w")).agg(F.count("*").alias("n_documents"), F.sum(bad).alias("n_rejected"))
    return counted.select(F.col("w.start").alias("window_start"), "n_documents", "n_rejected")
