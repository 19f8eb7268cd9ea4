"""Campaign windows as the spend arrives.

The batch operator (``operators.campaigns.detect_campaigns``) starts a new window after a
gap of more than ``gap_days``.  Here the same windows are session windows of a stream:
a window is kept in the state store while spend within the gap may still
come, also out of order, and is emitted once when the watermark is past its end.  Files may
come in any order as long as none is later than the watermark's delay.  A restart goes on
from the checkpoint; the file sink publishes each batch once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.money import money

WINDOW_SCHEMA = "start date, end date, total_spend_usd decimal(20,2)"


def session_windows(spend: DataFrame, gap_days: int = 7, delay: str = "30 days", keys: tuple[str, ...] = (),
                    date: str = "date", value: str = "amount_usd") -> DataFrame:
    """Windows (keys, start, end, total_spend_usd) of a stream or a table of spend rows."""
    rows = spend.select(*keys, F.col(date).cast("timestamp").alias("_ts"), F.col(value).alias("_v"))
    if spend.isStreaming:
        rows = rows.withWatermark("_ts", delay)
    # Days that are gap_days apart belong together, those one more do not.
    session = F.session_window("_ts", f"{gap_days * 24 + 12} hours")
    # A stream has no session windows without a key.
    rows = rows.withColumn("_all", F.lit(0))
    g = rows.groupBy(session.alias("_w"), "_all", *keys).agg(F.max("_ts").alias("_last"), F.sum("_v").alias("_sum"))
    return g.select(*keys, F.to_date("_w.start").alias("start"), F.to_date("_last").alias("end"),
                    money(F.col("_sum")).alias("total_spend_usd"))


def start_session_windows(spend: DataFrame, target_path: str, checkpoint_location: str, gap_days: int = 7,
                          delay: str = "30 days", keys: tuple[str, ...] = (), available_now: bool = True) -> StreamingQuery:
    """Writes closed windows of a stream of spend rows as Parquet files."""
    w = session_windows(spend, gap_days, delay, keys).writeStream.format("parquet").outputMode("append") \
        .option("path", target_path).option("checkpointLocation", checkpoint_location)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def closed_windows(spark: SparkSession, target_path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The windows emitted so far, numbered like those of the batch operator.  Windows are
    numbered per key, by the calendar; a later window never changes an earlier number
    as long as no window is emitted before one that starts earlier."""
    rows = spark.read.parquet(target_path)
    order = Window.partitionBy(*keys).orderBy("start")
    return rows.select(*keys, F.concat(F.lit("campaign_"), F.row_number().over(order).cast("string")).alias("campaign_id"),
                       "start", "end", "total_spend_usd")
