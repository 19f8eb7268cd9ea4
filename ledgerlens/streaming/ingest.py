"""Incremental ad-spend ingest with Structured Streaming.

New expense CSV files dropped in a folder are read as a stream, reduced to
ad-platform rows and appended to the spend table with the idempotent
``append_new_rows`` in ``foreachBatch``: a micro-batch carries its number as a tag, so
one replayed after a failure is known as loaded, and a killed one left nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import EXPENSE_SCHEMA
from ..sources.sinks import append_new_rows, spend_rows


def spend_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    raw = (spark.readStream.schema(EXPENSE_SCHEMA).option("header", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir))
    return spend_rows(raw)


def start_spend_ingest(spark: SparkSession, source_dir: str, target_path: str,
                       checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """``checkpoint_location`` is the shared folder of this stream: a restart
    with the same one goes on where the last run ended."""

    def write_batch(df: DataFrame, epoch_id: int) -> None:
        append_new_rows(df, target_path, tag=f"{checkpoint_location}#{epoch_id}")

    w = spend_stream(spark, source_dir).writeStream.foreachBatch(write_batch).option("checkpointLocation",
                                                                                               checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
