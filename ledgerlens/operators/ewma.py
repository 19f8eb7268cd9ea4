"""EWMA of long series as a prefix scan in built-in expressions.

A series is cut at time buckets.  Within (key, bucket) the weighted sum is a window
sum of values scaled by the row number, in blocks short enough for doubles; a bucket's
effect on all later rows is one affine map, ``carry -> w ** n * carry + sum``, and these
are folded over the key's buckets, which the calendar bounds.  The sum of the weights
needs only a row's place in the series, which counts by bucket give.  So one key of any
length is spread over its buckets, and no task holds a series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import dbl

SPAN = 7
#: Rows of a group in which the rolling deviation is taken; the rows before a group that
#: it needs are repeated in it.
GROUP = 4096


def _block(w: float) -> int:
    """Rows over which powers of 1 / w stay far from the limits of doubles."""
    return max(1, min(512, int(200 * math.log(2) / -math.log(w)))) if w > 0 else 1


def ewma_scan(series: DataFrame, value: str, ts: str = "date", keys: tuple[str, ...] = (), span: int = SPAN,
              bucket: str = "month") -> DataFrame:
    """keys, ts, value, ewm, residual and rolling_std of every row with a time, as
    ``operators.series.ewma_fit``; rows of equal time are in the order of their values.  A
    null value counts as 0."""
    w = 1.0 - 2.0 / (span + 1)
    size = _block(w)
    by = [f"_k{i}" for i in range(len(keys))]
    rows = series.where(F.col(ts).isNotNull()).select(
        *[F.col(k).alias(b) for k, b in zip(keys, by)], F.col(ts).alias("_t"), F.coalesce(dbl(value), F.lit(0.0)).alias("_v"),
        F.date_trunc(bucket, F.col(ts)).alias("_b"))
    order = Window.partitionBy(*by, "_b").orderBy("_t", "_v")
    rows = rows.withColumn("_i", F.row_number().over(order) - 1)
    power = lambda n: F.pow(F.lit(w), n)
    rows = rows.withColumn("_j", F.floor(F.col("_i") / size)).withColumn("_m", F.col("_i") % size)
    inside = Window.partitionBy(*by, "_b", "_j").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", power(F.col("_m")) * F.sum(F.col("_v") / power(F.col("_m"))).over(inside))
    # Blocks of a bucket, then the buckets of a key: what enters each of them.
    blocks = rows.groupBy(*by, "_b", "_j").agg(F.max_by("_own", "_m").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    steps = blocks.groupBy(*by, "_b").agg(F.sum("_n").alias("_rows"), F.array_sort(F.collect_list(F.struct("_j", "_sum", "_n"))).alias("_blocks"))

    def fold(state: Column, step: Column) -> Column:
        return F.struct((step["_sum"] + power(step["_n"]) * state["carry"]).alias("carry"),
                        F.concat(state["out"], F.array(state["carry"])).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<double>").alias("out"))
    steps = steps.withColumn("_f", F.aggregate("_blocks", start, fold)).withColumn("_sum", F.col("_f.carry"))
    per_key = steps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_b", "_sum", F.col("_rows").alias("_n")))).alias("_buckets"))
    before = F.aggregate("_buckets", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("out")),
                         lambda s, x: F.struct((s["n"] + x["_n"]).alias("n"), F.concat(s["out"], F.array(s["n"])).alias("out")))
    other = [F.col(b).alias(f"x{b}") for b in by]
    entering = per_key.select(*other, F.inline(F.arrays_zip(
        F.transform("_buckets", lambda x: x["_b"]).alias("_xb"), F.aggregate("_buckets", start, fold)["out"].alias("_in"),
        before["out"].alias("_before"))))
    # Carry into a block: from the bucket's own blocks, and what entered the bucket.
    blocks_in = steps.select(*other, F.col("_b").alias("_xb"), F.inline(F.arrays_zip(
        F.transform("_blocks", lambda x: x["_j"]).alias("_xj"), F.col("_f.out").alias("_carry"))))
    own = rows.columns
    on = lambda names: [F.col(n).eqNullSafe(F.col(x)) for n, x in names]
    of_key = [(b, f"x{b}") for b in by] + [("_b", "_xb")]
    j = rows.join(blocks_in, on([*of_key, ("_j", "_xj")])).select(*own, "_carry")
    j = j.join(entering, on(of_key)).select(*own, "_carry", "_in", "_before")
    number = F.col("_before") + F.col("_i")
    total = F.col("_own") + power(F.col("_m") + 1) * F.col("_carry") + power(F.col("_i") + 1) * F.col("_in")
    weights = (F.lit(1.0) - power(number + 1)) / F.lit(1.0 - w)
    fit = j.select(*by, "_t", "_v", number.cast("long").alias("_r"), (total / weights).alias("_e"))
    fit = fit.withColumn("_res", F.col("_v") - F.col("_e"))
    # Rolling deviation within groups of the series, with the last rows of the group before.
    g = F.floor(F.col("_r") / GROUP)
    near_end = F.col("_r") % GROUP > GROUP - span
    fit = fit.select("*", F.explode(F.when(near_end, F.array(g, g + 1)).otherwise(F.array(g))).alias("_g"))
    rolling = Window.partitionBy(*by, "_g").orderBy("_r").rowsBetween(-(span - 1), 0)
    fit = fit.withColumn("_std", F.coalesce(F.stddev_samp("_res").over(rolling), F.lit(0.0))).where(F.col("_g") == g)
    return fit.select(*[F.col(b).alias(k) for k, b in zip(keys, by)], F.col("_t").alias(ts), F.col("_v").alias(value),
                      F.col("_e").alias("ewm"), F.col("_res").alias("residual"), F.col("_std").alias("rolling_std"))
