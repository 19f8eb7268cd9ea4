"""Ad campaigns: spend loading, gap-and-island windows, cohort ROI / CAC,
daily cohort revenue and cumulative profit.

Campaign windows are a small table bounded by the calendar (at most one
window per spend day and key), so it is the broadcast side of every range
join; fact tables are only ever scanned and shuffled by their own keys.
All campaigns are answered by one plan (no per-campaign query loop).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import dbl, fine, money, nz, rnd, safe_div
from .users import KYC_COST_USD


# ------------------------------------------------------------------ spend
def classify_merchant(merchant: Column) -> Column:
    """FACEBK prefix -> meta; 'google ads' anywhere (any case) -> google; else null (dropped)."""
    return (F.when(merchant.startswith("FACEBK"), "meta")
            .when(F.lower(merchant).contains("google ads"), "google"))


def load_ad_spend(expenses: DataFrame, date: str = "date", amount: str = "amount",
                  merchant: str = "merchantName") -> DataFrame:
    """Expense-export rows -> (date, platform, daily_spend_usd) = sum of |amount|."""
    e = expenses.select(F.to_date(date).alias("date"), classify_merchant(F.col(merchant)).alias("platform"),
                        F.abs(F.col(amount)).alias("_a")).where(F.col("platform").isNotNull())
    return e.groupBy("date", "platform").agg(money(F.sum("_a")).alias("daily_spend_usd"))


def load_ad_spend_table(table: DataFrame, adjustment: float = 0.0, date: str = "date",
                        platform: str = "platform", amount: str = "amount_usd") -> DataFrame:
    """Stored spend rows -> per (date, platform) sums; an optional flat amount is
    taken off the latest meta day, floored at 0."""
    g = table.groupBy(F.to_date(date).alias("date"), F.col(platform).alias("platform")).agg(
        money(F.sum(amount)).alias("daily_spend_usd"))
    if not adjustment:
        return g
    last = g.where(F.lower("platform") == "meta").agg(F.max("date").alias("_last"))
    j = g.crossJoin(F.broadcast(last))
    hit = (F.lower("platform") == "meta") & (F.col("date") == F.col("_last"))
    adj = F.greatest(F.col("daily_spend_usd") - F.lit(str(adjustment)).cast("decimal(20,2)"), F.lit(0))
    return j.select("date", "platform", money(F.when(hit, adj).otherwise(F.col("daily_spend_usd")))
                    .alias("daily_spend_usd"))


def aggregate_spend(spend: DataFrame, platform: str | None = None) -> DataFrame:
    s = spend if platform is None else spend.where(F.col("platform") == platform)
    return s.groupBy("date").agg(money(F.sum("daily_spend_usd")).alias("daily_spend_usd"))


def spend_by_platform(spend: DataFrame) -> DataFrame:
    return spend.groupBy("platform").agg(dbl(F.sum("daily_spend_usd")).alias("total_spend_usd"),
                                         F.count_distinct("date").alias("n_days"))


# ---------------------------------------------------------------- windows
def detect_campaigns(spend_daily: DataFrame, gap_days: int = 7, keys: tuple[str, ...] = (),
                     date: str = "date", value: str = "daily_spend_usd") -> DataFrame:
    """Gap-and-island sessionisation: a gap of more than ``gap_days`` between
    consecutive spend days starts a new window.  One row per spend day is
    windowed (per key), so a task holds at most one key's calendar."""
    d = spend_daily.groupBy(*keys, F.to_date(date).alias("date")).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("date")
    new = F.coalesce(F.datediff("date", F.lag("date").over(w)) > gap_days, F.lit(True))
    d = d.withColumn("_new", new.cast("int"))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*keys, "_island").agg(F.min("date").alias("start"), F.max("date").alias("end"),
                                        money(F.sum("_v")).alias("total_spend_usd"))
    return g.select(*keys, F.concat(F.lit("campaign_"), F.col("_island").cast("string")).alias("campaign_id"),
                    "start", "end", "total_spend_usd")


def campaign_days(campaigns: DataFrame) -> DataFrame:
    """(day, campaign_id, start) for every day inside a window; where windows
    overlap the later window wins.  Its size is the number of campaign days
    (bounded by the calendar), so it is the broadcast side of day equi-joins."""
    d = campaigns.select("campaign_id", "start",
                         F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("_day"))
    return d.groupBy("_day").agg(F.max_by(F.struct("campaign_id", "start"), "start").alias("_c")).select(
        "_day", F.col("_c.campaign_id").alias("campaign_id"), F.col("_c.start").alias("start"))


def tag_campaign_window(days: DataFrame, campaigns: DataFrame, date: str = "date") -> DataFrame:
    """Day -> campaign (start <= day <= end), later window wins; untagged days
    get is_campaign = false and an empty id.  Equi-join on the day against the
    broadcast campaign-day table (no nested-loop range join)."""
    cd = F.broadcast(campaign_days(campaigns).select("_day", F.col("campaign_id").alias("_cid")))
    j = days.join(cd, days[date] == cd["_day"], "left")
    return j.select(*[days[c] for c in days.columns], F.col("_cid").isNotNull().alias("is_campaign"),
                    F.coalesce(F.col("_cid"), F.lit("")).alias("campaign_id"))


def daily_context(signups_daily: DataFrame, spend_daily: DataFrame, campaigns: DataFrame,
                  context_days_before: int = 14) -> DataFrame:
    """Daily signups from ``context_days_before`` days before the first window,
    with that day's spend and the campaign tag (days without signups absent)."""
    first = campaigns.agg(F.min("start").alias("_first"))
    s = signups_daily.crossJoin(F.broadcast(first)).where(
        F.col("signup_date") >= F.date_sub("_first", context_days_before)).select(
        F.col("signup_date").alias("date"), "new_signups")
    j = s.join(spend_daily, "date", "left").select("date", "new_signups",
                                                   dbl(nz("daily_spend_usd")).alias("daily_spend_usd"))
    return tag_campaign_window(j, campaigns)


# --------------------------------------------------------------- cohorts
def assign_cohort(users: DataFrame, campaigns: DataFrame, ts: str = "created_at",
                  referral_users: DataFrame | None = None) -> DataFrame:
    """(user_id, campaign_id, start) for users who signed up inside a window:
    a hash join on the signup day against the broadcast campaign-day table,
    so the cost is linear in users.  The optional referral filter is a semi
    join added only when a code is given."""
    u = users.select("user_id", F.to_date(F.col(ts)).alias("_day"))
    if referral_users is not None:
        u = u.join(referral_users.select("user_id"), "user_id", "left_semi")
    return u.join(F.broadcast(campaign_days(campaigns)), "_day").select("user_id", "campaign_id", "start")


def cohort_semi_join(facts: DataFrame, cohort: DataFrame, user: str = "user_id") -> DataFrame:
    """Facts of cohort users, tagged with their campaign (each user is in at
    most one window, so this is a key join, not a fan-out)."""
    return facts.join(cohort.withColumnRenamed("user_id", user), user, "inner")


def user_revenue(conv: DataFrame, streams: DataFrame, fx: DataFrame, include_swaps: bool = False) -> DataFrame:
    """All-time per-user revenue terms (USD) used by the cohort queries: the
    conversion revenue of each user (brl, usdc) and the wide sums of the other
    streams (see ``users.ledger_sums``)."""
    onr = conv.crossJoin(F.broadcast(fx.select("fx_rate"))).select(
        "user_id", money(fine(safe_div("brl", "fx_rate")) + nz("usdc")).alias("onramp_rev_usd"))
    j = onr.join(streams, "user_id", "full_outer")
    cols = ["onramp_rev_usd", "card_fee_usd", "billing_usd", "swap_fee_usd", "cashback_usd", "revenue_share_usd"]
    j = j.select("user_id", *[money(nz(c)).alias(c) for c in cols])
    if not include_swaps:
        j = j.withColumn("swap_fee_usd", money(F.lit(0)))
    total = money(F.col("onramp_rev_usd") + F.col("card_fee_usd") + F.col("billing_usd") + F.col("swap_fee_usd")
                  - F.col("cashback_usd") - F.col("revenue_share_usd"))
    return j.withColumn("total_revenue_usd", total)


REV_COLS = ["onramp_rev_usd", "card_fee_usd", "billing_usd", "swap_fee_usd", "cashback_usd", "revenue_share_usd",
            "total_revenue_usd"]


def cohort_revenue_summary(cohort: DataFrame, revenue: DataFrame, transacting: DataFrame) -> DataFrame:
    """One row per campaign: users, transacting users, revenue by stream (rounded 4)."""
    t = transacting.select(F.col("user_id").alias("_t")).distinct()
    j = (cohort.join(revenue, "user_id", "left").join(t, F.col("user_id") == F.col("_t"), "left"))
    return j.groupBy("campaign_id").agg(
        F.count_distinct("user_id").alias("cohort_users"),
        F.count_distinct("_t").alias("transacting_users"),
        *[rnd(nz(F.sum(c)), 4).alias(c) for c in REV_COLS])


def kyc_by_level(users: DataFrame, cohort: DataFrame) -> DataFrame:
    """Cohort users with a KYC level of 1 or more, per campaign."""
    j = cohort_semi_join(users.where(F.col("kyc_level") >= 1).select("user_id"), cohort)
    return j.groupBy("campaign_id").agg(F.count_distinct("user_id").alias("kyc_users"))


def kyc_by_verification(verifications: DataFrame, cohort: DataFrame) -> DataFrame:
    """Approved (GREEN) and completed verifications of cohort users, per campaign
    and day of completion.  The two sources of KYC counts may disagree, so each
    has an operator of its own."""
    done = verifications.where((F.col("status") == "completed") & (F.col("review_answer") == "GREEN"))
    j = cohort_semi_join(done.select("user_id", F.to_date("completed_at").alias("date")), cohort)
    return j.groupBy("campaign_id", "date").agg(F.count(F.lit(1)).alias("kyc_count"))


def baseline_rate(signups_daily: DataFrame, campaigns: DataFrame, window_days: int = 7,
                  all_days: bool = False) -> DataFrame:
    """Mean daily signups in the window before each campaign start, over the days
    *with* signups or, with ``all_days``, over the length of the window; 0 when
    there are none."""
    c = F.broadcast(campaigns.select("campaign_id", "start"))
    j = signups_daily.join(c, (F.col("signup_date") >= F.date_sub("start", window_days))
                           & (F.col("signup_date") < F.col("start")))
    days = F.lit(window_days) if all_days else F.count("new_signups")
    b = j.groupBy("campaign_id").agg(safe_div(F.sum("new_signups"), days).alias("_b"),
                                     F.sum("new_signups").alias("_s"))
    return campaigns.select("campaign_id").join(b, "campaign_id", "left").select(
        "campaign_id", F.when(nz("_s") > 0, F.col("_b")).otherwise(F.lit(0.0)).alias("baseline"))


def campaign_roi(campaigns: DataFrame, summary: DataFrame, baseline: DataFrame) -> DataFrame:
    j = campaigns.join(summary, "campaign_id", "left").join(baseline, "campaign_id", "left")
    dur = (F.datediff("end", "start") + 1).cast("bigint")
    users_ = nz("cohort_users")
    tx = nz("transacting_users")
    incr = F.greatest(dbl(users_) - F.col("baseline") * dur, F.lit(0.0))
    spend = dbl("total_spend_usd")
    rev = nz("total_revenue_usd")
    return j.select(
        "campaign_id", "start", "end", dur.alias("duration_days"),
        rnd("total_spend_usd", 2).alias("total_spend_usd"),
        users_.cast("bigint").alias("cohort_users"), tx.cast("bigint").alias("transacting_users"),
        F.when(users_ > 0, rnd(safe_div(tx, users_), 4)).alias("transacting_rate"),
        rnd("baseline", 1).alias("baseline_rate_per_day"),
        rnd(incr, 0).alias("incremental_users_est"),
        rnd(rev, 2).alias("total_revenue_usd"),
        F.when(spend > 0, rnd(safe_div(rev, spend), 4)).alias("roas"),
        F.when(tx > 0, rnd(safe_div(spend, tx), 2)).alias("cac_full"),
        F.when(incr > 0, rnd(safe_div(spend, incr), 2)).alias("cac_incremental"),
        F.when(tx > 0, rnd(safe_div(rev, tx), 2)).alias("avg_rev_per_transacting_user"))


STREAMS = ("conversion", "card_fee", "billing", "swap", "cashback", "rev_share")


def cohort_daily_revenue(signed_rows: DataFrame) -> DataFrame:
    """signed_rows: (campaign_id, rev_date, rev_usd, src) union of the six
    streams (costs negative).  Pivot by an explicit src list plus total."""
    s = signed_rows
    g = s.groupBy("campaign_id", "rev_date").agg(
        *[money(F.sum(F.when(F.col("src") == k, F.col("rev_usd")).otherwise(F.lit(0)))).alias(f"_{k}")
          for k in STREAMS], money(F.sum("rev_usd")).alias("_tot"))
    return g.select("campaign_id", "rev_date",
                    rnd("_conversion", 4).alias("daily_rev_conversion_usd"),
                    rnd("_card_fee", 4).alias("daily_rev_card_fees_usd"),
                    rnd("_billing", 4).alias("daily_rev_billing_usd"),
                    rnd("_swap", 4).alias("daily_rev_swap_usd"),
                    rnd(-F.col("_cashback"), 4).alias("daily_cost_cashback_usd"),
                    rnd(-F.col("_rev_share"), 4).alias("daily_cost_rev_share_usd"),
                    rnd("_tot", 4).alias("daily_rev_usd"))


def campaign_spine(campaigns: DataFrame, as_of: str) -> DataFrame:
    """(campaign_id, date) for every day from each campaign start to as_of."""
    return campaigns.select("campaign_id", F.explode(F.sequence(
        "start", F.greatest(F.to_date(F.lit(as_of)), F.col("start")), F.expr("INTERVAL 1 DAY"))).alias("date"))


_DAILY = ["daily_rev_conversion_usd", "daily_rev_card_fees_usd", "daily_rev_billing_usd", "daily_rev_swap_usd",
          "daily_cost_cashback_usd", "daily_cost_rev_share_usd", "daily_rev_usd"]


def cumulative_revenue(daily_rev: DataFrame, campaigns: DataFrame, as_of: str,
                       include_swaps: bool = False) -> DataFrame:
    """Zero-filled daily cohort revenue from each campaign start to as_of, plus a
    running total (the swap stream is taken out unless included)."""
    sp = campaign_spine(campaigns, as_of)
    j = sp.join(daily_rev.withColumnRenamed("rev_date", "date"), ["campaign_id", "date"], "left")
    j = j.select("campaign_id", "date", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in _DAILY])
    if not include_swaps:
        j = j.withColumn("daily_rev_usd", F.col("daily_rev_usd") - F.col("daily_rev_swap_usd")).withColumn(
            "daily_rev_swap_usd", F.lit(0.0))
    w = Window.partitionBy("campaign_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumn("cum_rev_usd", rnd(F.sum(fine("daily_rev_usd")).over(w), 4))


def unit_cost_by_period(invoices: DataFrame, period: str = "period", total: str = "invoice_total_usd",
                        count: str = "n_transactions") -> DataFrame:
    """Cost per transaction per invoice period; periods with no transactions are skipped."""
    g = invoices.groupBy(period).agg(F.sum(total).alias("_t"), F.sum(count).alias("_n"))
    return g.where(F.col("_n") > 0).select(F.col(period).alias("period"),
                                           fine(safe_div("_t", "_n")).alias("cost_per_txn"))


def asof_unit_cost(daily_counts: DataFrame, unit_costs: DataFrame, date: str = "date",
                   count: str = "txn_count") -> DataFrame:
    """Backward as-of join: rate for the row's month, else the latest earlier
    month, else the earliest month; times the count.  The rate table has one
    row per invoice month (calendar-bounded) and is broadcast.  An empty rate
    table gives 0."""
    rates = F.broadcast(unit_costs.select("period", "cost_per_txn"))
    months = daily_counts.select(F.date_format(date, "yyyy-MM").alias("_m")).distinct()
    back = (months.join(rates, F.col("period") <= F.col("_m"), "left")
            .groupBy("_m").agg(F.max_by("cost_per_txn", "period").alias("_back")))
    first = unit_costs.agg(F.min_by("cost_per_txn", "period").alias("_first"))
    m = back.crossJoin(F.broadcast(first)).select("_m", F.coalesce("_back", "_first").alias("_rate"))
    j = daily_counts.join(m, F.date_format(date, "yyyy-MM") == F.col("_m"), "left")
    return j.select(*[daily_counts[c] for c in daily_counts.columns],
                    money(nz(fine(dbl(count) * dbl("_rate")))).alias("cogs_usd"))


def cumulative_profit(cum_rev: DataFrame, txn_daily: DataFrame, conv_daily: DataFrame, kyc_daily: DataFrame,
                      spend_daily: DataFrame, unit_costs: DataFrame, kyc_cost: float = KYC_COST_USD) -> DataFrame:
    """Daily and cumulative profit per campaign cohort on the campaign spine."""
    base = cum_rev.drop("cum_rev_usd")
    keys = ["campaign_id", "date"]
    j = (base.join(txn_daily, keys, "left").join(conv_daily, keys, "left").join(kyc_daily, keys, "left")
         .join(spend_daily.select("date", F.col("daily_spend_usd").alias("_spend")), "date", "left"))
    j = j.select(*base.columns, nz("txn_count").cast("bigint").alias("daily_txn_count"),
                 nz("conv_count").cast("bigint").alias("daily_conversion_count"),
                 nz("kyc_count").cast("bigint").alias("_kyc"), dbl(nz("_spend")).alias("daily_ad_spend_usd"))
    j = asof_unit_cost(j, unit_costs, "date", "daily_txn_count")
    j = j.withColumnRenamed("daily_rev_usd", "daily_rev_total_usd").select(
        "*", dbl("cogs_usd").alias("daily_card_cogs_usd"),
        (dbl("_kyc") * F.lit(float(kyc_cost))).alias("daily_kyc_cost_usd"))
    profit = F.col("daily_rev_total_usd") - F.col("daily_card_cogs_usd") - F.col("daily_kyc_cost_usd")
    j = j.withColumn("daily_profit_usd", profit).withColumn(
        "daily_contribution_margin_usd", F.col("daily_profit_usd") - F.col("daily_ad_spend_usd"))
    w = Window.partitionBy("campaign_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cums = {
        "cum_rev_conversion_usd": "daily_rev_conversion_usd", "cum_rev_card_fees_usd": "daily_rev_card_fees_usd",
        "cum_rev_billing_usd": "daily_rev_billing_usd", "cum_rev_swap_usd": "daily_rev_swap_usd",
        "cum_cost_cashback_usd": "daily_cost_cashback_usd", "cum_cost_rev_share_usd": "daily_cost_rev_share_usd",
        "cum_rev_usd": "daily_rev_total_usd", "cum_card_cogs_usd": "daily_card_cogs_usd",
        "cum_kyc_cost_usd": "daily_kyc_cost_usd", "cum_contribution_margin_usd": "daily_contribution_margin_usd",
        "cum_profit_usd": "daily_profit_usd",
    }
    out = j.select("campaign_id", "date", *[rnd(c, 4).alias(c) for c in
                                            ["daily_rev_conversion_usd", "daily_rev_card_fees_usd",
                                             "daily_rev_billing_usd", "daily_rev_swap_usd",
                                             "daily_cost_cashback_usd", "daily_cost_rev_share_usd",
                                             "daily_rev_total_usd", "daily_card_cogs_usd", "daily_ad_spend_usd",
                                             "daily_kyc_cost_usd", "daily_contribution_margin_usd",
                                             "daily_profit_usd"]],
                   "daily_txn_count", "daily_conversion_count",
                   *[rnd(F.sum(fine(src)).over(w), 4).alias(name) for name, src in cums.items()],
                   F.sum("daily_txn_count").over(w).alias("cum_txn_count"),
                   F.sum("daily_conversion_count").over(w).alias("cum_conversion_count"))
    return out


# ---------------------------------------------------------- series on top
def running_roas(daily: DataFrame, date: str = "date", revenue: str = "daily_rev_usd",
                 spend: str = "daily_spend_usd", keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative revenue / forward-filled cumulative spend, on rows with spend > 0."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    cum_rev = F.sum(fine(revenue)).over(w)
    cum_spend = F.sum(fine(F.when(F.col(spend) > 0, F.col(spend)))).over(w)
    d = daily.select(*keys, date, spend, cum_rev.alias("_cr"), cum_spend.alias("_cs"))
    d = d.withColumn("_cs", F.last("_cs", ignorenulls=True).over(w))
    return d.where(F.col(spend) > 0).select(*keys, date, rnd(safe_div("_cr", "_cs"), 6).alias("running_roas"))


def payback_days(daily: DataFrame, date: str = "date", cum: str = "cum_profit_usd",
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Days from the first row to the first row with cumulative profit > 0 (null if never)."""
    g = daily.groupBy(*keys).agg(F.min(date).alias("_first"), F.min(F.when(F.col(cum) > 0, F.col(date))).alias("_pos"))
    return g.select(*keys, F.datediff("_pos", "_first").cast("bigint").alias("payback_days"))


def cumulative_spend(spend_daily: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Running spend and a flag + id on campaign start days."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per spend day
    s = spend_daily.select("date", "daily_spend_usd", dbl(F.sum("daily_spend_usd").over(w)).alias("cum_spend_usd"))
    st = F.broadcast(campaigns.select(F.col("start").alias("date"), F.col("campaign_id").alias("_cid")))
    j = s.join(st, "date", "left")
    return j.select("date", dbl("daily_spend_usd").alias("daily_spend_usd"), "cum_spend_usd",
                    F.col("_cid").isNotNull().alias("is_campaign_start"),
                    F.coalesce(F.col("_cid"), F.lit("")).alias("campaign_id"))


def campaign_totals(roi: DataFrame, profit: DataFrame | None = None) -> DataFrame:
    """Total spend, revenue, ROAS and the last contribution margin over campaigns."""
    t = roi.agg(dbl(F.sum(fine("total_spend_usd"))).alias("total_spend_usd"),
                dbl(F.sum(fine("total_revenue_usd"))).alias("total_revenue_usd"))
    t = t.withColumn("roas", rnd(safe_div("total_revenue_usd", F.nullif(F.col("total_spend_usd"), F.lit(0.0))), 4))
    if profit is not None:
        last = profit.agg(F.max_by("cum_contribution_margin_usd", F.struct("date", "campaign_id"))
                          .alias("last_contribution_margin_usd"))
        t = t.crossJoin(last)
    return t


def weighted_cac(roi: DataFrame) -> DataFrame:
    return roi.agg(rnd(safe_div(F.sum(fine("total_spend_usd")),
                                F.nullif(F.sum(fine("incremental_users_est")), F.lit(0))), 6).alias("weighted_cac"))


def campaign_cac_active(summary: DataFrame, campaigns: DataFrame, kyc_users: DataFrame,
                        kyc_cost: float = KYC_COST_USD) -> DataFrame:
    """(spend + KYC users x cost) / transacting users, per campaign."""
    j = campaigns.join(summary, "campaign_id", "left").join(kyc_users, "campaign_id", "left")
    cost = fine(dbl("total_spend_usd") + dbl(nz("kyc_users")) * F.lit(float(kyc_cost)))
    return j.select("campaign_id", nz("kyc_users").cast("bigint").alias("kyc_users"),
                    rnd(safe_div(cost, F.nullif(nz("transacting_users"), F.lit(0))), 2).alias("cac_active"))


def revenue_vs_spend_daily(revenue_daily: DataFrame, spend_daily: DataFrame) -> DataFrame:
    j = revenue_daily.join(spend_daily, "date", "full_outer")
    return j.select("date", dbl(nz("revenue_usd")).alias("revenue_usd"),
                    dbl(nz("daily_spend_usd")).alias("daily_spend_usd"))


def cohort_vs_all_boundary(all_daily: DataFrame, cohort_daily: DataFrame, spend_daily: DataFrame) -> DataFrame:
    """Daily all-user revenue minus cohort revenue (floor 0), outer-joined with spend."""
    a = all_daily.join(cohort_daily, "date", "left").select(
        "date", dbl(F.greatest(money(nz("all_rev_usd")) - money(nz("cohort_rev_usd")), F.lit(0))).alias("non_cohort_rev_usd"),
        dbl(nz("cohort_rev_usd")).alias("cohort_rev_usd"))
    j = a.join(spend_daily, "date", "full_outer")
    return j.select("date", F.coalesce("non_cohort_rev_usd", F.lit(0.0)).alias("non_cohort_rev_usd"),
                    F.coalesce("cohort_rev_usd", F.lit(0.0)).alias("cohort_rev_usd"),
                    dbl(nz("daily_spend_usd")).alias("daily_spend_usd"))


def channel_comparison(roi: DataFrame, acquisition: DataFrame, profit_usd: DataFrame | None = None) -> DataFrame:
    """Campaign totals row stacked on the acquisition-source rows; spend and
    ROAS are null for the organic channels."""
    camp = roi.agg(F.lit("paid_campaigns").alias("channel"), F.sum("cohort_users").cast("bigint").alias("n_users"),
                   dbl(F.sum(fine("total_revenue_usd"))).alias("revenue_usd"),
                   dbl(F.sum(fine("total_spend_usd"))).alias("spend_usd"))
    if profit_usd is not None:
        camp = camp.crossJoin(F.broadcast(profit_usd)).withColumn("revenue_usd", F.col("profit_usd")).drop(
            "profit_usd")
    camp = camp.withColumn("roas", rnd(safe_div("revenue_usd", F.nullif(F.col("spend_usd"), F.lit(0.0))), 4))
    other = acquisition.select(F.col("acquisition_source").alias("channel"), F.col("n_users").cast("bigint"),
                               dbl("total_net_revenue_usd").alias("revenue_usd"))
    return camp.unionByName(other, allowMissingColumns=True)
