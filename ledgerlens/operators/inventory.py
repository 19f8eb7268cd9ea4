"""Inventory positions kept up to date load by load.

The state of a position after a day is its quantity, average cost and cumulative
PnL (a *closing*).  A load of events is applied to the stored closings: the keys it
touches are replayed from their first touched day on, starting from the last closing
before that day.  In the usual case the load lies behind all stored days, and only its own
events are read; late rows for a past day bring back the later events of
their keys, as every later average rests on the quantity before it.  Other keys, and
the days before, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .scan import position_rows

STATE = ("_q", "_avg", "_pnl_cum")


def closings(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, day and the state after the day's last event, from :func:`position_rows`."""
    return rows.groupBy(*keys, F.to_date("_ts").alias("day")).agg(*[F.max_by(c, "_row").alias(c) for c in STATE])


def touched_days(batch: DataFrame, keys: tuple[str, ...], ts: str = "created_at") -> DataFrame:
    """The keys of a load and the first day of each."""
    return batch.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.min(F.to_date(ts)).alias("first_day"))


def _of_touched(df: DataFrame, touched: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    t = touched.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "first_day")
    return df.join(t, [df[k].eqNullSafe(t[f"_t_{k}"]) for k in keys])


def apply_load(stored: DataFrame | None, history: DataFrame | None, batch: DataFrame, keys: tuple[str, ...],
               ts: str = "created_at", id_col: str = "id", rate: str = "effective_rate") -> tuple[DataFrame, DataFrame]:
    """(closings after the load, restated closings).  ``stored``: the closings so far;
    ``history``: the events behind them, of which those of touched keys and days are
    read; ``batch``: new events, none of them in ``history``.  ``keys`` are the keys of the
    positions, one at least (a constant for one position of all)."""
    touched = written_table(touched_days(batch, keys, ts), "touched-days")
    replay, opening = batch, None
    if history is not None:
        later = _of_touched(history, touched, keys).where(F.to_date(ts) >= F.col("first_day"))
        replay = batch.unionByName(later.select(*[history[c] for c in batch.columns]))
    if stored is not None:
        before = _of_touched(stored, touched, keys).where(F.col("day") < F.col("first_day"))
        opening = before.groupBy(*[stored[k] for k in keys]).agg(*[F.max_by(c, "day").alias(c) for c in STATE])
    restated = written_table(closings(position_rows(replay, keys, ts, id_col, rate, opening=opening, along=()), keys), "restated")
    if stored is None:
        return restated, restated
    t = touched.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "first_day")
    kept = stored.join(t, [stored[k].eqNullSafe(t[f"_t_{k}"]) for k in keys] + [stored["day"] >= t["first_day"]], "left_anti")
    return written_table(kept.unionByName(restated), "closings"), restated


def closing_positions(state: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Closings in currency units."""
    return state.select(*keys, "day", (F.col("_q").cast("decimal(30,0)") * F.expr("0.000001")).alias("position_qty_usdc"),
                        F.col("_avg").alias("avg_price_brl_per_usdc"),
                        (F.col("_pnl_cum").cast("decimal(30,0)") * F.expr("0.00000001")).alias("pnl_cum_brl"))
