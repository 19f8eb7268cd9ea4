"""As-of join by key and time without an inequality join.

Facts and rates are one ordered stream per key; a fact takes the last rate before or
at its time.  A key's stream is cut at time buckets (days by default), so that a key
that holds most of the rows is spread over its buckets:

1. within (key, bucket), a window carries the last rate to the facts behind it;
2. one row per (key, bucket) with its last rate is carried over the key's buckets,
   which the calendar bounds, and gives the rate that enters each bucket;
3. facts before the first rate of their bucket take the entering one.

The plan has equi-joins and windows on (key, bucket) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(facts: DataFrame, rates: DataFrame, keys: list[str], ts: str, rate_ts: str, values: list[str],
              bucket: str = "day", tolerance: str | None = None, first_if_none: bool = False) -> DataFrame:
    """All rows and columns of ``facts`` with ``values`` of the rate of the same keys that
    is the last at or before ``ts``; null where there is none, or where it is older than
    the ``tolerance`` (an interval, e.g. ``INTERVAL 30 DAYS``).  With ``first_if_none`` a
    fact before the first rate of its keys takes that one.  Of several rates at one time
    the largest counts.  A null key matches nothing, a null time neither; rates without
    a time are left out."""
    from functools import reduce
    quoted = [F.col(f"`{c}`") for c in facts.columns]
    by = [f"_k{i}" for i in range(len(keys))]
    fact_keys = [F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)]
    known = reduce(Column.__and__, [F.col(b).isNotNull() for b in by])
    at = lambda c: F.col(f"`{c}`").cast("timestamp_ntz")
    rate = F.struct(at(rate_ts).alias("_at"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    r = rates.select(*fact_keys, at(rate_ts).alias("_ts"), F.lit(0).alias("_side"), rate.alias("_rate")).where(
        F.col("_ts").isNotNull() & known)
    f = facts.select(*fact_keys, at(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*quoted).alias("_fact"))
    matched = known & F.col("_ts").isNotNull()
    u = f.where(matched).unionByName(r, allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, "_ts"))
    inside = Window.partitionBy(*by, "_b").orderBy("_ts", "_side", "_rate").rowsBetween(Window.unboundedPreceding, 0)
    carried = u.withColumn("_own", F.last("_rate", ignorenulls=True).over(inside)).where("_side = 1")
    # Rates that enter each bucket of a key.
    latest = u.groupBy(*by, "_b").agg(F.max("_rate").alias("_last"), F.min("_rate").alias("_least"))
    over = Window.partitionBy(*by).orderBy("_b")
    entering = latest.select(*by, "_b", F.last("_last", ignorenulls=True).over(
        over.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
        F.first("_least", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"))
    j = carried.join(entering, [*by, "_b"])
    found = F.coalesce("_own", "_in")
    if tolerance:
        found = F.when(found["_at"] >= F.col("_ts") - F.expr(tolerance), found)
    if first_if_none:
        found = F.coalesce(found, F.when(F.coalesce("_own", "_in").isNull(), F.col("_first")))
    none = f.where(~F.coalesce(matched, F.lit(False))).select("_fact", F.lit(None).cast(u.schema["_rate"].dataType).alias("_found"))
    out = j.select("_fact", found.alias("_found")).unionByName(none)
    return out.select("_fact.*", *[F.col("_found")[f"v{i}"].alias(v) for i, v in enumerate(values)])


def account_unit_costs(invoices: DataFrame, period: str = "period", total: str = "invoice_total_usd",
                       count: str = "n_transactions", account: str = "account_id") -> DataFrame:
    """Cost per transaction of each account and invoice, valid from the day after the
    invoiced month; invoices without transactions are skipped."""
    from ..functions.money import fine, safe_div
    g = invoices.groupBy(account, period).agg(F.sum(total).alias("_t"), F.sum(count).alias("_n")).where(F.col("_n") > 0)
    start = F.add_months(F.to_date(F.concat(F.col(period), F.lit("-01"))), 1)
    return g.select(F.col(account), start.alias("valid_from"), fine(safe_div("_t", "_n")).alias("cost_per_txn"))
