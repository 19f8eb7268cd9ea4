"""Active users from mergeable day bitmaps.

A distinct count cannot be added up: every window of days is another distinct over
the facts.  Here the facts are read once.  Users get numbers, and every day gets a bitmap
of the numbers of its users, in pieces of 32,768 users.  Bitmaps of days merge by OR:
a load of a day, or of late rows for a past one, is merged into the stored bitmaps,
and any 1, 7 or 30 days, week or month is an OR of stored pieces and a count of bits.

A piece has 4 KB whatever the number of rows behind it, and pieces are aggregated map-side.
The sliding windows run over the days of one piece, which the calendar bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_start
from ..session import written_table

PIECE_USERS = 32_768


def user_numbers(users: DataFrame, known: DataFrame | None = None, user: str = "user_id") -> DataFrame:
    """user and its number (``n``) for the distinct users of ``users`` and for those in
    ``known``, which keep theirs.  New numbers start in a new piece.  Numbers are given
    by the task that holds a user, so the table is written before it is used."""
    ids = users.select(F.col(user).alias("user")).where(F.col("user").isNotNull()).distinct()
    first = 0
    if known is not None:
        known = known.select("user", "n")
        ids = ids.join(known, "user", "left_anti")
        highest = known.agg(F.max("n")).first()[0]
        first = 0 if highest is None else (highest // PIECE_USERS + 1) * PIECE_USERS
    new = ids.select("user", (F.monotonically_increasing_id() + F.lit(first) + 1).alias("n"))
    return written_table(new if known is None else known.unionByName(new), "user-numbers")


def daily_bitmaps(activity: DataFrame, numbers: DataFrame, user: str = "user_id", date: str = "activity_date") -> DataFrame:
    """One row per day and piece of users: date, piece, bits.  Rows without user or
    day count for nobody."""
    rows = activity.select(F.col(user).alias("user"), F.to_date(date).alias("date")).where(
        F.col("date").isNotNull()).join(numbers, "user")
    return rows.groupBy("date", F.bitmap_bucket_number("n").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """The bitmaps of several loads as one table."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("date", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))


def rolling_active(bitmaps: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Per day from the first to the last one with activity, the users active in the
    last ``windows[name]`` days, the day included."""
    days = bitmaps.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    spine = days.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    # A piece has a row on every day of the calendar, as users stay active on days without a row.
    pieces = bitmaps.groupBy("piece").agg(F.min("date").alias("since"))
    grid = pieces.join(F.broadcast(spine), F.col("date") >= F.col("since")).select("piece", "date")
    rows = grid.join(bitmaps, ["piece", "date"], "left").withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    order = Window.partitionBy("piece").orderBy("day")

    def users(n: int) -> Column:
        return F.coalesce(F.bitmap_count(F.bitmap_or_agg("bits").over(order.rangeBetween(1 - n, 0))), F.lit(0))

    counted = rows.select("date", *[users(n).alias(name) for name, n in windows.items()])
    return counted.groupBy("date").agg(*[F.sum(name).alias(name) for name in windows])


def active_by_period(bitmaps: DataFrame, freq: str = "M") -> DataFrame:
    """Users active in each week or month."""
    merged = bitmaps.groupBy(period_start("date", freq).alias("period"), "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("period").agg(F.sum(F.bitmap_count("bits")).alias("active_users"))


def returning_by_period(bitmaps: DataFrame, freq: str = "M") -> DataFrame:
    """Per week or month: active users, and those of them active in the one before."""
    step = F.expr("INTERVAL 7 DAYS" if freq.upper().startswith("W") else "INTERVAL 1 MONTH")
    merged = bitmaps.groupBy(period_start("date", freq).alias("period"), "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
    before = merged.select((F.col("period") + step).cast("date").alias("period"), "piece", F.lit(False).alias("own"), "bits")
    both = merged.select("period", "piece", F.lit(True).alias("own"), "bits").unionByName(before)
    pairs = both.groupBy("period", "piece").agg(
        F.sum(F.when(F.col("own"), F.bitmap_count("bits"))).alias("active"), F.count(F.lit(1)).alias("sides"),
        F.bitmap_and_agg("bits").alias("bits"))
    return pairs.groupBy("period").agg(
        F.sum("active").alias("active_users"),
        F.sum(F.when(F.col("sides") == 2, F.bitmap_count("bits")).otherwise(0)).alias("returning_users")
    ).where(F.col("active_users").isNotNull())
