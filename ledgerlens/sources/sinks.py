"""Sinks: idempotent append by id and record export."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.campaigns import classify_merchant
from .id_table import IdTable


def spend_rows(expenses: DataFrame) -> DataFrame:
    """Expense rows -> (id, date, amount_usd, platform) for ad platforms only."""
    p = classify_merchant(F.col("merchantName"))
    return expenses.select(F.col("id").cast("string").alias("id"), F.to_date("date").alias("date"),
                           F.abs(F.col("amount")).cast("decimal(10,4)").alias("amount_usd"), p.alias("platform")
                           ).where(F.col("platform").isNotNull())


def new_rows(batch: DataFrame, existing: DataFrame | None, id_col: str = "id",
             order: list[Column] | None = None) -> DataFrame:
    """Rows to insert: one row per id (the first by ``order``, default the
    whole row, so the choice is deterministic) and only ids absent from the
    target (left anti join)."""
    cols = [c for c in batch.columns]
    order = order or [F.col(c) for c in cols if c != id_col]
    first = batch.groupBy(id_col).agg(F.min_by(F.struct(*[F.col(c) for c in cols if c != id_col]),
                                               F.struct(*order)).alias("_r"))
    dedup = first.select(id_col, "_r.*")
    if existing is not None:
        dedup = dedup.join(existing.select(id_col), id_col, "left_anti")
    return dedup.select(*cols)


def load_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """rows_inserted and rows_skipped (duplicates inside the batch count as skipped)."""
    b = batch.agg(F.count(F.lit(1)).alias("_b"))
    i = inserted.agg(F.count(F.lit(1)).alias("rows_inserted"))
    return b.crossJoin(i).select("rows_inserted", (F.col("_b") - F.col("rows_inserted")).alias("rows_skipped"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def append_new_rows(batch: DataFrame, target_path: str, id_col: str = "id", tag: str | None = None) -> tuple[int, int]:
    """Idempotent load: the rows of ``batch`` whose id is not yet in the target, an
    :class:`IdTable`, are added in one step; only the files that may hold an id of the
    batch are read.  A folder of plain Parquet files is taken over first (its rows
    become the first version).  Re-running a batch inserts nothing.  Returns (inserted,
    skipped)."""
    table = IdTable(batch.sparkSession, target_path, id_col)
    if not table.version() and _exists(batch.sparkSession, target_path):
        try:
            table.publish(batch.sparkSession.read.parquet(target_path), 0)
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":     # an empty folder
                raise
    return table.load(batch, tag)


def export_records(df: DataFrame) -> DataFrame:
    """Any report -> one JSON record per row (dates and months as ISO text)."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        cols.append(F.col(f.name).cast("string").alias(f.name) if t in ("date", "timestamp", "timestamp_ntz")
                    else F.col(f.name))
    return df.select(F.to_json(F.struct(*cols)).alias("record"))


def write_records(df: DataFrame, path: str) -> None:
    export_records(df).write.mode("overwrite").text(os.fspath(path))
