"""Cohort tables kept up to date load by load.

What is stored is one row per user and month (additive sums) and one per cohort cell
(signup month, months since signup).  A load is aggregated to its own user-months,
these are merged into the stored ones by addition, and only the cells of the
cohorts that have users in the load are made again, from the user-months of these cohorts.
Late rows for a past month are merged the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_index
from ..functions.money import r6, safe_div
from ..session import written_table


def user_months(facts: DataFrame, ts: str, sums: dict[str, Column], user: str = "user_id") -> DataFrame:
    """user_id, month, n_rows and the sums of facts with a user and a time."""
    rows = facts.where(F.col(user).isNotNull() & F.col(ts).isNotNull())
    return rows.groupBy(F.col(user).alias("user_id"), F.trunc(F.to_date(ts), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(v).alias(k) for k, v in sums.items()])


def _added(parts: list[DataFrame]) -> DataFrame:
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    terms = [c for c in rows.columns if c not in ("user_id", "month")]
    return rows.groupBy("user_id", "month").agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in terms])


def cohort_cells(months: DataFrame, base: DataFrame) -> DataFrame:
    """signup_month, months_since_signup, active_users, first_active_users (of whom it is
    the first active month) and the sums.  Months before the signup are left out."""
    j = months.join(base.select("user_id", F.trunc(F.to_date("signup_date"), "month").alias("signup_month")), "user_id")
    j = j.withColumn("months_since_signup", (month_index("month") - month_index("signup_month")).cast("bigint"))
    j = j.where(F.col("months_since_signup") >= 0)
    first = F.min("months_since_signup").over(Window.partitionBy("user_id"))    # a user's months
    j = j.withColumn("_first", F.col("months_since_signup") == first)
    terms = [c for c in months.columns if c not in ("user_id", "month")]
    return j.groupBy("signup_month", "months_since_signup").agg(
        F.count("user_id").alias("active_users"), F.count_if("_first").alias("first_active_users"),
        *[F.sum(c).cast(months.schema[c].dataType).alias(c) for c in terms])


def apply_months(stored: DataFrame | None, cells: DataFrame | None, delta: DataFrame,
                 base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user-months, cells, cells made again) after a load of user-months ``delta``."""
    delta = written_table(delta, "delta-months")
    merged = delta if stored is None else written_table(_added([stored, delta]), "user-months")
    cohort = base.select("user_id", F.trunc(F.to_date("signup_date"), "month").alias("_cohort"))
    # Signup months of the load: bounded by the calendar.
    touched = written_table(delta.join(cohort, "user_id").select("_cohort").distinct().where(F.col("_cohort").isNotNull()), "touched-cohorts")
    users = cohort.join(F.broadcast(touched), "_cohort", "left_semi").select("user_id")
    again = written_table(cohort_cells(merged.join(users, "user_id", "left_semi"), base), "restated-cells")
    if cells is None:
        return merged, again, again
    kept = cells.join(F.broadcast(touched), F.col("signup_month") == F.col("_cohort"), "left_anti")
    return merged, written_table(kept.unionByName(again), "cohort-cells"), again


def retention_report(cells: DataFrame, amount: str) -> DataFrame:
    """Retention and running amount of each cell.  The windows run over a cohort's cells."""
    of = Window.partitionBy("signup_month")
    run = of.orderBy("months_since_signup").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("signup_month", "months_since_signup", "active_users",
                        r6(safe_div("active_users", F.sum("first_active_users").over(of))).alias("retention"), amount,
                        F.sum(amount).over(run).alias(f"cum_{amount}"))
