"""Product revenue series and windows, monthly merges, spines and enriched top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import day_spine, in_window, spine_from
from ..functions.money import dbl, fine, money, nz, safe_div
from .users import acquisition_source, ledger_rows


PRODUCT_STREAMS = ("card_fee_usd", "billing_usd", "swap_fee_usd")


def daily_revenue_by_product(conv: DataFrame, ledger: DataFrame, start: str | None = None, end: str | None = None,
                             rate: str = "exchange_rate", swaps_enabled: bool = True) -> DataFrame:
    """Zero-filled daily revenue (USD) per product over [start, end] inclusive
    (from the first to the last day with revenue where a bound is missing): the
    conversions join the ledger as one more stream, one aggregate per day sums
    them all and is joined to the day spine (the spine includes the end date)."""
    r = F.nullif(F.col(rate), F.lit(0))
    conv_usd = (nz(fine(safe_div(nz("fee_amount_brl"), r))) + nz("fee_amount_usdc")
                + nz(fine(safe_div(nz("spread_revenue_brl"), r))) + nz("spread_revenue_usdc"))
    streams = PRODUCT_STREAMS if swaps_enabled else PRODUCT_STREAMS[:-1]
    own = conv.where(in_window("created_at", start, end)).select(
        F.to_date("created_at").alias("date"), money(conv_usd).alias("conversion"))
    other = ledger_rows(ledger, streams, start, end).select(F.to_date("ts").alias("date"), *streams)
    srcs = ("conversion", *streams)
    g = own.unionByName(other, allowMissingColumns=True).groupBy("date").agg(*[F.sum(c).alias(c) for c in srcs])
    if not swaps_enabled:
        g = g.withColumn("swap_fee_usd", money(F.lit(0)))
    sp = day_spine(conv.sparkSession, start, end, "date") if start and end else spine_from(g, "date")
    j = sp.join(g, "date", "left")
    cols = {"daily_rev_conversion_usd": "conversion", "daily_rev_card_fees_usd": "card_fee_usd",
            "daily_rev_billing_usd": "billing_usd", "daily_rev_swap_usd": "swap_fee_usd"}
    total = reduce(lambda a, b: money(a + b), [money(nz(s)) for s in cols.values()])
    return j.select("date", *[dbl(money(nz(src))).alias(name) for name, src in cols.items()],
                    dbl(total).alias("daily_rev_usd"))


def revenue_totals_by_window(card_fees: DataFrame, billing: DataFrame, start: str, end: str) -> DataFrame:
    """Annual fees (paid) and billing (settled) over a window; 0 when empty."""
    f = card_fees.where((F.col("status") == "paid") & in_window("created_at", start, end)).agg(
        money(nz(F.sum("amount_usdc"))).alias("annual_fees_usd"))
    b = billing.where((F.col("status") == "settled") & in_window("created_at", start, end)).agg(
        money(nz(F.sum(F.col("amount").cast("decimal(20,0)") * F.expr("0.000001")))).alias("billing_usd"))
    return f.crossJoin(b).select(dbl("annual_fees_usd").alias("annual_fees_usd"), dbl("billing_usd").alias("billing_usd"))


def monthly_card_revenue_terms(card_fees: DataFrame, billing: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    f = card_fees.where((F.col("status") == "paid") & in_window("created_at", start, end)).groupBy(
        F.trunc(F.to_date("created_at"), "month").alias("month")).agg(money(F.sum("amount_usdc")).alias("annual_fee_usd"))
    b = billing.where((F.col("status") == "settled") & in_window("created_at", start, end)).groupBy(
        F.trunc(F.to_date("created_at"), "month").alias("month")).agg(
        money(F.sum(F.col("amount").cast("decimal(20,0)") * F.expr("0.000001"))).alias("billing_usd"))
    return f, b


def card_revenue_monthly(fees_m: DataFrame, billing_m: DataFrame) -> DataFrame:
    """Full outer join of the two monthly series on month; gaps -> 0."""
    j = fees_m.join(billing_m, "month", "full_outer")
    return j.select("month", dbl(nz("annual_fee_usd")).alias("annual_fee_usd"),
                    dbl(nz("billing_usd")).alias("billing_usd"),
                    dbl(nz("annual_fee_usd") + nz("billing_usd")).alias("card_revenue_usd"))


def merge_monthly_streams(base: DataFrame, streams: DataFrame) -> DataFrame:
    """Left join of the wide (user_id, month) streams onto the monthly base; gaps -> 0."""
    names = [c for c in streams.columns if c not in ("user_id", "month")]
    return base.join(streams, ["user_id", "month"], "left").select(*base.columns, *[money(nz(n)).alias(n) for n in names])


def self_first_value_join(df: DataFrame, key: str, value: str, name: str = "first_value") -> DataFrame:
    """Per-key minimum attached to every row (a window, not a self join)."""
    return df.withColumn(name, F.min(value).over(Window.partitionBy(key)))


def calendar_spine_join(daily: DataFrame, spine: DataFrame, date: str, value_cols: list[str]) -> DataFrame:
    """Every day of the spine with the sparse daily facts, gaps -> 0."""
    j = spine.join(daily, date, "left")
    return j.select(date, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in value_cols])


def top_spenders_enriched(card_tx: DataFrame, users: DataFrame, registrations: DataFrame, founders: DataFrame,
                          referral_codes: DataFrame, conv: DataFrame, n: int = 20, start: str | None = None,
                          end: str | None = None) -> DataFrame:
    """Top-n card spenders first (aggregate -> order -> limit), then the
    lookups: only n rows ever reach the joins (limit before join)."""
    spend = card_tx.where((F.col("status") == "completed") & (F.col("transaction_type") == "spend")
                          & F.col("posted_at").isNotNull() & in_window("posted_at", start, end))
    agg = spend.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_transactions"),
                                       money(F.sum(F.col("amount_usd_cents").cast("decimal(20,0)") * F.expr("0.01")))
                                       .alias("_total"))
    top = agg.orderBy(F.col("_total").desc(), F.col("user_id").asc()).limit(n)
    ramp = conv.where(F.col("used")).groupBy("user_id").agg(F.count(F.lit(1)).alias("ramp_conversions"))
    t = F.broadcast(top)   # n rows
    j = (t.join(users.select("user_id", "full_name"), "user_id", "left")
         .join(registrations, "user_id", "left")
         .join(referral_codes.select(F.col("id").alias("attributed_referral_code_id"), "code", "public_name"),
               "attributed_referral_code_id", "left")
         .join(founders.select("user_id", "invite_code"), "user_id", "left")
         .join(ramp, "user_id", "left"))
    return j.select("user_id", "full_name",
                    acquisition_source(F.col("source_type"), F.col("invite_code"), "unknown").alias("acquisition_source"),
                    F.col("code").alias("referral_code"), F.col("public_name").alias("referral_code_name"),
                    "n_transactions", dbl("_total").alias("total_usd"),
                    nz("ramp_conversions").cast("bigint").alias("ramp_conversions"))


def param_grid_cross_join(aggregate_row: DataFrame, grid: DataFrame, expr: Column, name: str) -> DataFrame:
    """A one-row aggregate crossed with a small parameter grid (aggregate first,
    then the grid: cost rows + grid, not rows x grid)."""
    return grid.crossJoin(F.broadcast(aggregate_row)).select(*grid.columns, expr.alias(name))


def volume_monthly_total(daily: DataFrame, date: str = "date") -> DataFrame:
    return daily.groupBy(F.trunc(date, "month").alias("month")).agg(
        dbl(F.sum(fine("onramp"))).alias("onramp"), dbl(F.sum(fine("offramp"))).alias("offramp"),
        dbl(F.sum(fine("onramp")) + F.sum(fine("offramp"))).alias("total"))
