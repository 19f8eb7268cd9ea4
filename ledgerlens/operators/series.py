"""Time-series metrics: EWMA fit and forecast, month-over-month change,
rolling means, last values, usage summary, Lorenz curve and top-decile share."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import dbl, fine, mean_exact, r6, rnd, safe_div
from ..session import ensure_checkpoint_dir, ensure_python_package

#: Rows folded at a time, so that the output grows by blocks and not by single values.
EWMA_BLOCK = 64
EWMA_SPAN = 7
FORECAST_DAYS = 5
Z_95 = 1.96


def ewma_fit(daily: DataFrame, value: str, date: str = "date", keys: tuple[str, ...] = (),
             span: int = EWMA_SPAN) -> DataFrame:
    """Bias-adjusted EWMA (weights (1-a)^k, a = 2/(span+1)), residuals and the
    7-row sample std of residuals (0 while undefined).  Each key's series is
    folded in order with a SQL ``aggregate`` over its sorted daily array, so a
    task holds one key's calendar, never the whole table."""
    w = 1.0 - 2.0 / (span + 1)
    g = daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"),
                                                                       dbl(value).alias("v")))).alias("_s"))
    none = F.array().cast("array<double>")

    def state(num, den, out):
        return F.struct(num.alias("num"), den.alias("den"), out.alias("out"))

    def step(acc, x):
        num = x["v"] + F.lit(w) * acc["num"]
        den = F.lit(1.0) + F.lit(w) * acc["den"]
        return state(num, den, F.concat(acc["out"], F.array(num / den)))

    def block(acc, first):
        done = F.aggregate(F.slice("_s", first, F.lit(EWMA_BLOCK)), state(acc["num"], acc["den"], none), step)
        return state(done["num"], done["den"], F.concat(acc["out"], done["out"]))

    starts = F.sequence(F.lit(1), F.size("_s"), F.lit(EWMA_BLOCK))
    folded = g.where(F.size("_s") > 0).select(
        *keys, "_s", F.aggregate(starts, state(F.lit(0.0), F.lit(0.0), none), block)["out"].alias("_e"))
    rows = folded.select(*keys, F.inline(F.arrays_zip(F.col("_s").alias("s"), F.col("_e").alias("e"))))
    rows = rows.select(*keys, F.col("s.d").alias(date), F.col("s.v").alias(value), F.col("e").alias("ewm"))
    rows = rows.withColumn("residual", F.col(value) - F.col("ewm"))
    wr = Window.partitionBy(*keys).orderBy(date).rowsBetween(-(span - 1), 0)
    return rows.withColumn("rolling_std", F.coalesce(F.stddev_samp("residual").over(wr), F.lit(0.0)))


def ewma_forecast(daily: DataFrame, value: str, date: str = "date", keys: tuple[str, ...] = (),
                  span: int = EWMA_SPAN, horizon: int = FORECAST_DAYS) -> DataFrame:
    """Mean-reverting forecast: level_h = L + (1-a)^h (level_0 - L) with L the
    mean of the last 30 days, times the weekday factor, floored at 0, with a
    +-1.96 sigma sqrt(h) band (sigma = max(last rolling std, residual std))."""
    a = 2.0 / (span + 1)
    fit = ewma_fit(daily, value, date, keys, span)
    wd = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    f = fit.withColumn("_rn", F.row_number().over(wd))
    state = f.groupBy(*keys).agg(
        F.max_by("ewm", date).alias("_level"), F.max_by("rolling_std", date).alias("_rstd"),
        F.stddev_samp("residual").alias("_std"), F.max(date).alias("_last"),
        F.avg(F.when(F.col("_rn") <= 30, F.col(value))).alias("_lr"), F.avg(value).alias("_mean"))
    dow = f.groupBy(*keys, F.weekday(date).alias("_dow")).agg(F.avg(value).alias("_dm"))
    steps = state.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).select(
        *keys, "_level", "_rstd", "_std", "_lr", "_mean", "h", F.date_add("_last", F.col("h")).alias(date))
    steps = steps.select("*", F.weekday(date).alias("_dow"))
    j = steps.join(dow, [*keys, "_dow"], "left")
    factor = F.when(F.col("_mean") > 0, F.coalesce(F.col("_dm") / F.col("_mean"), F.lit(1.0))).otherwise(F.lit(1.0))
    level = F.col("_lr") + F.pow(F.lit(1 - a), F.col("h")) * (F.col("_level") - F.col("_lr"))
    pt = F.greatest(level * factor, F.lit(0.0))
    sigma = F.greatest(F.col("_rstd"), F.coalesce(F.col("_std"), F.lit(0.0)))
    margin = F.lit(Z_95) * sigma * F.sqrt(dbl("h"))
    return j.select(*keys, F.col("h").cast("bigint").alias("h"), date, pt.alias("forecast"),
                    F.greatest(pt - margin, F.lit(0.0)).alias("ci_lower"), (pt + margin).alias("ci_upper"))


def usage_summary(daily: DataFrame, count_fc: DataFrame, vol_fc: DataFrame, date: str = "date",
                  count: str = "daily_count", volume: str = "daily_volume_usd") -> DataFrame:
    """Last 7 / 30 days, full history and the 5-day forecast: sums and daily means."""
    last = daily.agg(F.max(date).alias("_today"))
    d = daily.crossJoin(F.broadcast(last))

    def win(n: int | None):
        c = F.lit(True) if n is None else (F.col(date) >= F.date_sub("_today", n - 1))
        return c

    # One aggregate for the three windows, then a row for each.
    windows = []
    for label, n in (("last_7d", 7), ("last_30d", 30), ("all", None)):
        c = win(n)
        windows.append(F.struct(F.lit(label).alias("period"),
                                dbl(F.sum(F.when(c, F.col(count)))).alias("tx_count"),
                                dbl(F.sum(F.when(c, fine(volume)))).alias("volume_usd"),
                                rnd(mean_exact(F.when(c, F.col(count))), 1).alias("avg_count_day"),
                                rnd(mean_exact(F.when(c, fine(volume))), 2).alias("avg_vol_day")))
    rows = [d.agg(F.array(*windows).alias("_w")).select(F.inline("_w"))]
    fc = count_fc.select("h", F.col("forecast").alias("_c")).join(vol_fc.select("h", F.col("forecast").alias("_v")), "h")
    rows.append(fc.agg(F.lit("next_5d_forecast").alias("period"), rnd(F.sum(fine("_c")), 1).alias("tx_count"),
                       rnd(F.sum(fine("_v")), 6).alias("volume_usd"), rnd(mean_exact(fine("_c")), 1).alias("avg_count_day"),
                       rnd(mean_exact(fine("_v")), 2).alias("avg_vol_day")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def mom_change(series: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """% change vs the previous row divided by |previous|; null when previous is 0
    or missing."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    return series.withColumn("mom_change_pct", F.when(prev != 0, r6((dbl(value) - dbl(prev)) / F.abs(dbl(prev)) * 100)))


def rolling_mean(daily: DataFrame, cols: dict[str, int], order: str = "date", rows: int = 7,
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the last ``rows`` rows (at least one), rounded per column."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return daily.select(*keys, order, *[rnd(safe_div(F.sum(fine(c)).over(w), F.count(c).over(w)), d)
                                        .alias(f"{c}_rolling_{rows}") for c, d in cols.items()])


def last_value_kpi(series: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Last non-null value by order."""
    s = series.where(F.col(value).isNotNull())
    return s.groupBy(*keys).agg(F.max_by(value, order).alias("last_value"), F.max(order).alias("as_of"))


def window_avg(series: DataFrame, value: str, order: str, n: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the last ``n`` rows."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    s = series.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return s.groupBy(*keys).agg(r6(mean_exact(fine(value))).alias(f"avg_last_{n}"))


# ------------------------------------------------------------ global ranks
def ordered_prefix(df: DataFrame, order_desc: str, tie: str, value: str, scale: int = 1_000_000,
                   num_partitions: int | None = None) -> DataFrame:
    """Global 1-based rank and running sum in (value desc, tie asc) order.

    Range-partitioned and checkpointed so partitions are contiguous; per
    partition counts and sums (one row each) give offsets; each partition then
    adds its offset to a local cumulative sum (exact, in integer units of
    1/scale), carried from one Arrow batch to the next.  No task holds more than
    one batch."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ensure_python_package(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    units = F.round(F.col(value) * F.lit(scale)).cast("long")
    base = df.select(tie, F.col(value).alias("_v"), units.alias("_u"))
    ordered = (base.repartitionByRange(n, F.col("_v").desc(), F.col(tie).asc())
               .sortWithinPartitions(F.col("_v").desc(), F.col(tie).asc())
               .withColumn("_pid", F.spark_partition_id())).checkpoint(eager=True)
    per = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum("_u").alias("_s"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    off = per.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_on"),
                     F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_os"))
    j = ordered.join(F.broadcast(off), "_pid")
    schema = T.StructType([f for f in j.schema.fields] + [T.StructField("rank", T.LongType()),
                                                          T.StructField("_cum", T.LongType())])

    def local(batches):
        # The partition arrives in order: rank and sum run on from batch to batch.
        rank = total = 0
        for pdf in batches:
            if pdf.empty:
                continue
            pdf["rank"] = pdf["_on"].astype("int64") + rank + pd.RangeIndex(1, len(pdf) + 1)
            pdf["_cum"] = pdf["_os"].astype("int64") + total + pdf["_u"].astype("int64").cumsum()
            rank, total = rank + len(pdf), total + int(pdf["_u"].sum())
            yield pdf

    tot = per.agg(F.sum("_n").alias("n_total"), F.sum("_s").alias("units_total"))
    return j.mapInPandas(local, schema).select(tie, F.col("_v").alias(value), "rank",
                                              F.col("_cum").alias("cum_units")).crossJoin(F.broadcast(tot))


def lorenz_curve(per_user: DataFrame, value: str = "net_revenue_usd", user: str = "user_id") -> DataFrame:
    """Users with positive value, descending: cumulative % of users and % of value."""
    pos = per_user.where(F.col(value) > 0).select(user, dbl(value).alias(value))
    j = ordered_prefix(pos, value, user, value)   # totals come from the partition summary
    return j.select(user, value, "rank", r6(dbl("rank") * 100 / dbl("n_total")).alias("cum_users_pct"),
                    r6(dbl("cum_units") * 100 / dbl("units_total")).alias("cum_revenue_pct"))


def top_decile_share(per_user: DataFrame, value: str = "net_revenue_usd", user: str = "user_id") -> DataFrame:
    """Share of positive value held by the top max(1, n div 10) users."""
    pos = per_user.where(F.col(value) > 0).select(user, dbl(value).alias(value))
    j = ordered_prefix(pos, value, user, value)  # one pass: every row has the totals
    k = F.greatest(F.lit(1).cast("long"), (F.col("n_total") / 10).cast("long"))
    share = F.when(F.col("rank") == k, r6(dbl("cum_units") * 100 / dbl("units_total")))
    none = F.lit(0).cast("long")
    return j.agg(F.coalesce(F.max(k), none).alias("top_n_users"), F.coalesce(F.max("n_total"), none).alias("n_positive_users"),
                 F.coalesce(F.max(share), F.lit(0.0)).alias("top_decile_share_pct"))
