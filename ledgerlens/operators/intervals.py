"""Join of points to intervals by key, as equi-joins.

An interval gets a level, the power of sixteen that is at least its length, and lies in at
most two aligned buckets of that width: it is stored under these.  A point looks its
bucket up once for each level that occurs; as each level makes a copy of all points in the
shuffle, levels are far apart.  The join is on (keys, level, bucket) and is verified by the
exact bounds; a bucket is at most sixteen times as wide as its intervals, so the candidates
stay within a constant of the intervals around a point and the work is linear in points, intervals
and matches, whatever the lengths of the intervals.  Time is counted in microseconds, so bounds
are exact for timestamps as well as for days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_BITS = 4


def _micros(c: str) -> Column:
    """Microseconds of a date or a timestamp, as wall clock."""
    ts = F.col(f"`{c}`").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def level(length: Column) -> Column:
    """Bits of the width of the buckets for intervals of a length."""
    bits = F.length(F.bin(length))      # the length is under 2 ** bits
    return F.least(F.ceil(bits / LEVEL_BITS).cast("int") * LEVEL_BITS, F.lit(63))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, start: str, end: str,
                  values: list[str], end_inclusive: bool = True) -> DataFrame:
    """Every row of ``points`` with ``values`` of each interval of its keys that holds
    ``ts``: start <= ts <= end, or start <= ts < end.  Points in no interval have no
    row, points in several have several.  Null keys and bounds hold nothing, an
    interval that ends before its start neither."""
    by = [f"_k{i}" for i in range(len(keys))]
    last = _micros(end) if end_inclusive else _micros(end) - 1
    iv = intervals.select(*[F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)], _micros(start).alias("_s"), last.alias("_e"),
                          F.struct(*[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)]).alias("_v"))
    iv = iv.where(F.col("_s") <= F.col("_e"))
    iv = iv.withColumn("_l", level(F.col("_e") - F.col("_s") + 1))
    shifted = lambda c: F.call_function("shiftright", F.col(c), F.col("_l"))
    first, final = shifted("_s"), shifted("_e")
    iv = iv.select("*", F.explode(F.array_distinct(F.array(first, final))).alias("_b"))
    # At most 16 levels in one row.
    levels = iv.agg(F.collect_set("_l").alias("_levels"))
    # A key is shuffled once, and buckets of points are made from their time.
    held = {c: by[keys.index(c)] if c in keys else f"_p{i}" for i, c in enumerate(points.columns)}
    pt = points.select(*[F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)], _micros(ts).alias("_t"),
                       *[F.col(f"`{c}`").alias(h) for c, h in held.items() if c not in keys]).where(F.col("_t").isNotNull())
    pt = pt.join(F.broadcast(levels), F.lit(True)).select(*pt.columns, F.explode("_levels").alias("_l"))
    stored = iv.select(*[F.col(b).alias(f"_i{b}") for b in by], F.col("_l").alias("_il"), "_b", "_s", "_e", "_v")
    same = [F.col(b) == F.col(f"_i{b}") for b in by] + [F.col("_l") == F.col("_il"), shifted("_t") == F.col("_b")]
    met = pt.join(stored, reduce(Column.__and__, same)).where((F.col("_t") >= F.col("_s")) & (F.col("_t") <= F.col("_e")))
    return met.select(*[F.col(h).alias(c) for c, h in held.items()], *[F.col("_v")[f"v{i}"].alias(v) for i, v in enumerate(values)])
