"""Cohort LTV, retention and activity matrices, kept in long format
(cohort, month offset, value); pivot only at the edge with an explicit list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_index
from ..functions.money import dbl, fine, mean_exact, money, nz, r6, safe_div
from .users import DEFAULT_INVOICE_USD, KYC_COST_USD


MONTH_TERMS = ("card_fee_usd", "billing_usd", "swap_fee_usd", "cashback_usd", "revenue_share_usd")


def merge_month_streams(streams: dict[str, DataFrame], card_monthly: DataFrame) -> DataFrame:
    """Separate (user_id, month, value) streams and the card counts as one wide
    frame per (user, month), by one aggregate over their union."""
    parts = [df.select("user_id", "month", F.col("value").alias(name)) for name, df in streams.items()]
    parts.append(card_monthly.select("user_id", "month", "n_card_txns"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("user_id", "month").agg(*[money(F.sum(n)).alias(n) for n in streams],
                                                F.sum("n_card_txns").alias("n_card_txns"))


def user_monthly_ltv(conv_monthly: DataFrame, streams: dict[str, DataFrame] | DataFrame,
                     card_monthly: DataFrame | None, base: DataFrame, fx: DataFrame,
                     invoice_total: float = DEFAULT_INVOICE_USD, kyc_cost: float = KYC_COST_USD,
                     months: str = "conversions", card_total: DataFrame | None = None) -> DataFrame:
    """Long table per (user, month since signup): net and gross revenue, the
    streams and running net / gross.

    conv_monthly: (user_id, month, conversion_revenue_brl, conversion_revenue_usdc);
    streams: name -> (user_id, month, value) for card_fee_usd, billing_usd,
    swap_fee_usd, cashback_usd, revenue_share_usd with card_monthly (user_id,
    month, n_card_txns), or one wide frame per (user, month) with all six columns
    and card_monthly None; base: one row per user (user_id, signup_date,
    acquisition_source); fx: one row with fx_rate; card_total: one row with the
    card transactions of all users (n_card_txns), summed here if not given.
    ``months="conversions"`` keeps the months that have a conversion (the
    original rule: card-only months are not counted); ``months="all_streams"``
    keeps every (user, month) present in any stream.  The KYC cost is charged
    once in the first active month.
    """
    if months not in ("conversions", "all_streams"):
        raise ValueError("months must be 'conversions' or 'all_streams'")
    wide = merge_month_streams(streams, card_monthly) if isinstance(streams, dict) else streams
    m = conv_monthly.join(wide, ["user_id", "month"], "left" if months == "conversions" else "full_outer")
    # Cost per card transaction = invoice / all transactions (one-row aggregate).
    total = card_total if card_total is not None else wide.agg(F.sum("n_card_txns").alias("n_card_txns"))
    cpt = total.select((F.lit(float(invoice_total)) / F.greatest(F.coalesce(dbl("n_card_txns"), F.lit(0.0)), F.lit(1.0)))
                       .alias("_cpt"))
    m = m.crossJoin(F.broadcast(fx.select("fx_rate"))).crossJoin(F.broadcast(cpt)).select(
        "user_id", "month",
        money(nz(fine(safe_div("conversion_revenue_brl", "fx_rate"))) + nz("conversion_revenue_usdc")).alias("conv_usd"),
        *[money(nz(c)).alias(c) for c in MONTH_TERMS],
        money(nz(fine(dbl("n_card_txns") * F.col("_cpt")))).alias("card_cost_usd"))
    gross = money(money(money(F.col("conv_usd") + F.col("card_fee_usd")) + F.col("billing_usd"))
                  + F.col("swap_fee_usd"))
    m = m.withColumn("gross_revenue_usd", gross)
    net = money(money(money(F.col("gross_revenue_usd") - F.col("cashback_usd")) - F.col("revenue_share_usd"))
                - F.col("card_cost_usd"))
    m = m.withColumn("revenue_usd", net)
    b = base.select("user_id", F.trunc(F.to_date("signup_date"), "month").alias("signup_month"),
                    "acquisition_source")
    j = m.join(b, "user_id", "inner")
    j = j.withColumn("months_since_signup",
                     (month_index("month") - month_index("signup_month")).cast("bigint"))
    j = j.where(F.col("months_since_signup") >= 0)
    wu = Window.partitionBy("user_id")
    first = F.min("months_since_signup").over(wu)
    j = j.withColumn("kyc_deducted", F.col("months_since_signup") == first)
    j = j.withColumn("revenue_usd", F.when(F.col("kyc_deducted"),
                                           money(F.col("revenue_usd") - F.lit(str(kyc_cost)).cast("decimal(10,2)")))
                     .otherwise(F.col("revenue_usd")))
    run = wu.orderBy("months_since_signup").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("user_id", "signup_month", "acquisition_source", "months_since_signup", "kyc_deducted",
                    "revenue_usd", "gross_revenue_usd", "card_fee_usd", "billing_usd", "swap_fee_usd",
                    money(F.sum("revenue_usd").over(run)).alias("cum_ltv"),
                    money(F.sum("gross_revenue_usd").over(run)).alias("cum_gross_ltv"))


def _cells(ltv: DataFrame, *aggs) -> DataFrame:
    """One aggregate per (cohort, month offset): users present and the given
    terms, beside the cohort's ever-active users.  A user has one row a month and
    one first month, so the first months of a cohort's cells (calendar-bounded)
    add up to its users without a second pass."""
    known = F.col("user_id").isNotNull()
    cells = ltv.groupBy("signup_month", "months_since_signup").agg(
        F.count("user_id").alias("active_users"), F.count_if(F.col("kyc_deducted") & known).alias("_first"), *aggs)
    return cells.withColumn("n_active_users", F.sum("_first").over(Window.partitionBy("signup_month")))


def cohort_ltv(ltv: DataFrame, value: str = "cum_ltv") -> DataFrame:
    """Sum of running value over users present at (cohort, offset) divided by
    the cohort's ever-active users."""
    return _cells(ltv, F.sum(value).alias("_s")).select(
        "signup_month", "months_since_signup", r6(safe_div("_s", "n_active_users")).alias("ltv_usd"))


def cohort_total_profit(ltv: DataFrame) -> DataFrame:
    return ltv.groupBy("signup_month", "months_since_signup").agg(dbl(F.sum("cum_ltv")).alias("total_profit_usd"))


def cohort_active_users(ltv: DataFrame) -> DataFrame:
    return ltv.groupBy("signup_month", "months_since_signup").agg(F.count("user_id").alias("active_users"))


def cohort_retention(ltv: DataFrame) -> DataFrame:
    return _cells(ltv).select("signup_month", "months_since_signup",
                              r6(safe_div("active_users", "n_active_users")).alias("retention"))


def retention_average(ltv: DataFrame, cac_usd: float | None = None) -> DataFrame:
    """Mean over cohorts at each offset of retention and of LTV; LTV:CAC when
    a CAC is given."""
    j = _cells(ltv, F.sum("cum_ltv").alias("_s")).select(
        "months_since_signup", fine(safe_div("active_users", "n_active_users")).alias("_ret"),
        fine(safe_div("_s", "n_active_users")).alias("_ltv"))
    out = j.groupBy("months_since_signup").agg(r6(mean_exact("_ret")).alias("avg_retention"),
                                               r6(mean_exact("_ltv")).alias("avg_ltv_usd"),
                                               F.count(F.lit(1)).alias("n_cohorts"))
    if cac_usd:
        out = out.withColumn("ltv_to_cac", r6(F.col("avg_ltv_usd") / F.lit(float(cac_usd))))
    return out


def cohort_summary(ltv: DataFrame, users_base: DataFrame | None = None) -> DataFrame:
    g = ltv.groupBy("signup_month").agg(
        F.count_if(F.col("kyc_deducted") & F.col("user_id").isNotNull()).alias("n_users"),
        money(F.sum("gross_revenue_usd")).alias("g"), money(F.sum("revenue_usd")).alias("n"),
        money(F.sum("card_fee_usd")).alias("cf"), money(F.sum("billing_usd")).alias("bl"),
        money(F.sum("swap_fee_usd")).alias("sw"),
        F.max("months_since_signup").alias("months_observed"))
    g = g.withColumn("n_active_users", F.col("n_users"))
    conv = F.col("g") - F.col("cf") - F.col("bl") - F.col("sw")
    return g.select(
        F.date_format("signup_month", "yyyy-MM").alias("cohort_month"), "n_users", "n_active_users",
        dbl("g").alias("total_gross_revenue_usd"), dbl("n").alias("total_net_revenue_usd"),
        dbl("cf").alias("total_card_fee_usd"), dbl("bl").alias("total_billing_usd"),
        dbl("sw").alias("total_swap_fee_usd"), dbl(conv).alias("total_conversion_revenue_usd"),
        "months_observed",
        r6(safe_div("g", F.nullif(F.col("n_active_users"), F.lit(0)))).alias("avg_gross_per_user_usd"),
        r6(safe_div("n", F.nullif(F.col("n_active_users"), F.lit(0)))).alias("avg_net_per_user_usd"),
        r6(safe_div((F.col("g") - F.col("n")) * 100, F.nullif(F.col("g"), F.lit(0)))).alias("cost_load_pct"))


def cohort_avg_dau(activity: DataFrame, base: DataFrame) -> DataFrame:
    """Mean over active days of distinct users per (cohort, offset)."""
    b = base.select("user_id", F.trunc(F.to_date("signup_date"), "month").alias("signup_month"))
    d = activity.join(b, "user_id").withColumn(
        "months_since_signup", (month_index("activity_date") - month_index("signup_month")).cast("bigint"))
    d = d.where(F.col("months_since_signup") >= 0)
    daily = d.groupBy("signup_month", "months_since_signup", "activity_date").agg(
        F.count_distinct("user_id").alias("dau"))
    return daily.groupBy("signup_month", "months_since_signup").agg(r6(F.avg("dau")).alias("avg_dau"))


def cohort_monthly_profit(ltv: DataFrame) -> DataFrame:
    """Net by calendar month x cohort, zero-filled over the (months x cohorts)
    grid; both axes are bounded by the calendar, not by the data volume."""
    c = ltv.select(F.add_months("signup_month", F.col("months_since_signup").cast("int")).alias("calendar_month"),
                   "signup_month", "revenue_usd")
    sums = c.groupBy("calendar_month", "signup_month").agg(F.sum("revenue_usd").alias("_s"))
    months = sums.select("calendar_month").distinct()
    cohorts = sums.select("signup_month").distinct()
    grid = months.crossJoin(cohorts)
    return grid.join(sums, ["calendar_month", "signup_month"], "left").select(
        "calendar_month", "signup_month", dbl(nz("_s")).alias("net_profit_usd"))


def ltv_by_source(ltv: DataFrame) -> DataFrame:
    """Mean running net by (source, cohort, offset), then averaged over cohorts."""
    a = ltv.groupBy("acquisition_source", "signup_month", "months_since_signup").agg(
        fine(mean_exact("cum_ltv")).alias("_m"))
    return a.groupBy("acquisition_source", "months_since_signup").agg(r6(mean_exact("_m")).alias("avg_cum_ltv_usd"),
                                                                      F.count(F.lit(1)).alias("n_cohorts"))


def cac_breakeven(ltv: DataFrame, cac_usd: float) -> DataFrame:
    """Per source: first offset whose mean running net reaches the CAC (null if
    never) and the best mean running net over offsets <= 12."""
    a = ltv.groupBy("acquisition_source", "months_since_signup").agg(
        (F.sum("cum_ltv") / F.count("cum_ltv")).alias("_m"))
    return a.groupBy("acquisition_source").agg(
        F.min(F.when(F.col("_m") >= F.lit(float(cac_usd)), F.col("months_since_signup"))).alias("payback_months"),
        r6(F.max(F.when(F.col("months_since_signup") <= 12, dbl("_m")))).alias("ltv_at_month_12"))


def pivot_offsets(long_df: DataFrame, row: str, value: str, offsets: list[int]) -> DataFrame:
    """Edge-only pivot with an explicit offset list (no data-dependent columns)."""
    return long_df.groupBy(row).pivot("months_since_signup", offsets).agg(F.first(value))
