"""Calendar helpers: the inclusive-end rule, day spines, week and month labels."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def end_exclusive(end: str) -> str:
    """The single end-date rule: a bare date is inclusive (next midnight is the
    exclusive bound); a value with a time part is used as is."""
    s = str(end).strip()
    if len(s) <= 10:
        d = _dt.date.fromisoformat(s) + _dt.timedelta(days=1)
        return d.isoformat()
    return s


def ts_lit(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz") if len(s) > 10 else F.to_date(F.lit(s)).cast("timestamp_ntz")


def in_window(ts_col: str | Column, start: str | None, end: str | None) -> Column:
    """``ts >= start AND ts < end_exclusive(end)`` on the raw column (pushes down)."""
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= ts_lit(start))
    if end is not None:
        cond = cond & (c < ts_lit(end_exclusive(end)))
    return cond


def day_spine(spark: SparkSession, start: str, end: str, name: str = "day") -> DataFrame:
    """Every day from start to end inclusive (both are dates)."""
    return spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)),
                             F.expr("INTERVAL 1 DAY"))).alias(name))


def spine_from(df: DataFrame, day_col: str, name: str | None = None) -> DataFrame:
    """Days between min and max of a date column.  The bounds are one aggregate
    row; the sequence is exploded on an executor (its length is the number of
    days in the range, not the number of rows)."""
    name = name or day_col
    return df.agg(F.min(day_col).alias("_lo"), F.max(day_col).alias("_hi")).where(
        F.col("_lo").isNotNull()).select(
        F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(name))


def month_start(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trunc(F.to_date(c), "month")


def month_index(c) -> Column:
    """year*12 + month, for whole-month offsets."""
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c)


def period_start(c, freq: str) -> Column:
    """Start of the day / ISO week (Monday) / month / quarter / year containing c."""
    c = F.col(c) if isinstance(c, str) else c
    f = freq.upper()
    unit = {"D": "day", "W": "week", "M": "month", "ME": "month", "MS": "month",
            "Q": "quarter", "QE": "quarter", "Y": "year", "YE": "year"}[f]
    return F.to_date(F.date_trunc(unit, c))


def week_ending_monday(c) -> Column:
    """Right-closed weekly bucket labelled by the Monday that ends it
    (a Monday stays on itself)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.next_day(F.date_sub(F.to_date(c), 1), "Mon")
