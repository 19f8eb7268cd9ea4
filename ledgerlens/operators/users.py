"""Per-user revenue model: cohort base, revenue streams, the master table,
leaderboards, adoption, funnel and user-level KPIs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import in_window
from ..functions.money import MONEY, dbl, fine, money, nz, r6, safe_div
from ..functions.quantiles import exact_percentiles

# Fixed values.
KYC_COST_USD = 2.07            # one-time verification cost per user
DEFAULT_INVOICE_USD = 6693.58  # card-processing invoice used for pro-rata cost
DAYS_PER_MONTH = 30.44


# ---------------------------------------------------------------- columns
def acquisition_source(source_type: Column, invite_code: Column, fallback: str = "organic") -> Column:
    """Registration source, else founder_invite for a non-blank invite code, else fallback."""
    return F.coalesce(source_type,
                      F.when(invite_code.isNotNull() & (invite_code != ""), F.lit("founder_invite"))
                      .otherwise(F.lit(fallback)))


def mask_user_id(c: Column | str, keep: int = 8) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.substring(c.cast("string"), 1, keep), F.lit("..."))


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Elapsed whole 24h periods (clipped at 0 by the callers); computed on
    wall-clock (NTZ) values so the session time zone cannot shift it."""
    return F.timestamp_diff("DAY", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz")).cast("bigint")


def time_signals(df: DataFrame, as_of: str, last_active: str = "last_active_at",
                 signup: str = "signup_date") -> DataFrame:
    """days_since_last_active (>= 0; a missing last activity counts from the epoch)
    and tenure_months = whole days since signup / 30.44 (>= 0)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    last = F.coalesce(F.col(last_active), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return df.withColumns({
        "days_since_last_active": F.greatest(whole_days_between(now, last), F.lit(0)).cast("bigint"),
        "tenure_months": F.greatest(whole_days_between(now, F.col(signup)) / F.lit(DAYS_PER_MONTH),
                                    F.lit(0.0)),
    })


# ------------------------------------------------------------------ joins
def cohort_base(users: DataFrame, registrations: DataFrame, referral_codes: DataFrame,
                founders: DataFrame, profiles: DataFrame, fallback: str = "organic") -> DataFrame:
    """users -> registration -> referral code -> founder -> profile (left joins).

    No broadcast hint on the referral-code dimension: its size is not bounded
    by construction, so the planner / AQE choose from the measured size."""
    u = users.alias("u")
    ur = registrations.alias("ur")
    rc = referral_codes.alias("rc")
    f = founders.alias("f")
    up = profiles.alias("up")
    j = (u.join(ur, F.col("ur.user_id") == F.col("u.user_id"), "left")
         .join(rc, F.col("rc.id") == F.col("ur.attributed_referral_code_id"), "left")
         .join(f, F.col("f.user_id") == F.col("u.user_id"), "left")
         .join(up, F.col("up.user_id") == F.col("u.user_id"), "left"))
    return j.select(
        F.col("u.user_id").alias("user_id"), F.col("u.full_name").alias("full_name"),
        F.col("u.created_at").alias("signup_date"), F.col("u.last_active_at").alias("last_active_at"),
        F.col("u.status").alias("status"), F.col("u.account_type").alias("account_type"),
        acquisition_source(F.col("ur.source_type"), F.col("f.invite_code"), fallback).alias("acquisition_source"),
        F.col("ur.attributed_referral_code_id").alias("referral_code_id"),
        F.col("rc.code").alias("referral_code"), F.col("rc.public_name").alias("referral_code_name"),
        F.col("rc.commission_rate_basis_points").alias("commission_rate_bps"),
        F.col("rc.code_type").alias("referral_code_type"),
        F.col("f.user_id").isNotNull().alias("is_founder"),
        F.col("f.founder_number").alias("founder_number"),
        F.col("f.network_size").alias("founder_network_size"),
        F.col("f.invites_remaining").alias("invites_remaining"),
        F.col("f.invite_code").alias("invite_code"),
        F.col("up.country_code").alias("country_code"),
        F.col("up.preferred_currency").alias("preferred_currency"),
        F.col("up.onboarding_completed").alias("onboarding_completed"),
        F.col("u.kyc_level").alias("kyc_level"))


def user_attribution(users: DataFrame, registrations: DataFrame, founders: DataFrame,
                     fallback: str = "unknown") -> DataFrame:
    """Smaller chain: source and founder flag (= a founder row exists)."""
    j = (users.select("user_id").join(registrations, "user_id", "left")
         .join(founders.select("user_id", "invite_code"), "user_id", "left"))
    f = founders.select(F.col("user_id").alias("_fid"))
    j = j.join(f, j.user_id == f._fid, "left")
    return j.select("user_id",
                    acquisition_source(F.col("source_type"), F.col("invite_code"), fallback)
                    .alias("acquisition_source"),
                    F.col("_fid").isNotNull().alias("is_founder"))


# -------------------------------------------------------- per-user streams
def conversion_revenue_per_user(conv: DataFrame, user: str = "user_id") -> DataFrame:
    """Six conditional sums by direction plus the count (conv in real units)."""
    on = F.col("direction") == "brl_to_usdc"
    off = F.col("direction") == "usdc_to_brl"
    rb = nz("fee_amount_brl") + nz("spread_revenue_brl")
    ru = nz("fee_amount_usdc") + nz("spread_revenue_usdc")
    z = F.lit(0)
    return conv.groupBy(F.col(user).alias("user_id")).agg(
        F.sum(F.when(on, rb).otherwise(z)).cast(MONEY).alias("onramp_revenue_brl"),
        F.sum(F.when(off, rb).otherwise(z)).cast(MONEY).alias("offramp_revenue_brl"),
        F.sum(F.when(on, ru).otherwise(z)).cast(MONEY).alias("onramp_revenue_usdc"),
        F.sum(F.when(off, ru).otherwise(z)).cast(MONEY).alias("offramp_revenue_usdc"),
        F.count(F.lit(1)).alias("n_conversions"),
        F.sum(F.when(on, nz("from_amount_brl")).otherwise(z)).cast(MONEY).alias("onramp_volume_brl"),
        F.sum(F.when(off, nz("from_amount_usdc")).otherwise(z)).cast(MONEY).alias("offramp_volume_usdc"))


def conversion_monthly(conv: DataFrame, ts: str = "created_at") -> DataFrame:
    return conv.groupBy("user_id", F.trunc(F.to_date(ts), "month").alias("month")).agg(
        money(F.sum(nz("fee_amount_brl") + nz("spread_revenue_brl"))).alias("conversion_revenue_brl"),
        money(F.sum(nz("fee_amount_usdc") + nz("spread_revenue_usdc"))).alias("conversion_revenue_usdc"))


def per_user_sum(df: DataFrame, value: Column, name: str, user: str = "user_id",
                 pred: Column | None = None, ts: str | None = None, start=None, end=None) -> DataFrame:
    """Filtered sum per user (optionally within a window)."""
    if pred is not None:
        df = df.where(pred)
    if ts is not None:
        df = df.where(in_window(ts, start, end))
    return df.groupBy(F.col(user).alias("user_id")).agg(money(F.sum(value)).alias(name))


def per_user_month_sum(df: DataFrame, value: Column, name: str, ts: str, user: str = "user_id",
                       pred: Column | None = None, start=None, end=None) -> DataFrame:
    if pred is not None:
        df = df.where(pred)
    df = df.where(in_window(ts, start, end))
    return df.groupBy(F.col(user).alias("user_id"), F.trunc(F.to_date(ts), "month").alias("month")).agg(
        money(F.sum(value)).alias(name))


def swap_fee_usd(usdc_mint: str = "USDC", enabled: bool = True) -> Column:
    """USDC-side amount / 1e6 * bps / 1e4 (input side first, else output side, else 0)."""
    if not enabled:
        return F.lit(0).cast("decimal(38,10)")
    return (F.when(F.col("input_mint") == usdc_mint,
                   F.col("input_amount").cast("decimal(20,0)") * F.col("platform_fee_bps").cast("decimal(5,0)")
                   * F.expr("0.0000000001"))
            .when(F.col("output_mint") == usdc_mint,
                  F.col("output_amount").cast("decimal(20,0)") * F.col("platform_fee_bps").cast("decimal(5,0)")
                  * F.expr("0.0000000001"))
            .otherwise(F.lit(0)))


def swaps_per_user(swaps: DataFrame, usdc_mint: str = "USDC", enabled: bool = False) -> DataFrame:
    return swaps.groupBy("user_id").agg(money(F.sum(swap_fee_usd(usdc_mint, enabled))).alias("swap_fee_usd"),
                                        F.count(F.lit(1)).alias("n_swaps"))


# ------------------------------------------------------- ledger of streams
def stream_ledger(streams: dict[str, DataFrame]) -> DataFrame:
    """Separate streams of (user_id, ts, value) as one wide frame: a row per
    event with its value in the column of its stream and null in the others."""
    parts = [df.select("user_id", "ts", F.col("value").alias(name)) for name, df in streams.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ledger_rows(ledger: DataFrame, names, start: str | None = None, end: str | None = None) -> DataFrame:
    """The window's rows with a value in at least one of the named streams."""
    known = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names])
    return ledger.where(in_window("ts", start, end) & known)


def ledger_month() -> Column:
    return F.trunc(F.to_date("ts"), "month").alias("month")


def ledger_sums(ledger: DataFrame, names, by=("user_id",), start: str | None = None,
                end: str | None = None) -> DataFrame:
    """Sums of the named streams per key: one aggregate (one shuffle) however
    many streams there are.  A stream without an event of the key is null;
    ``n_*`` streams are counts, the others money."""
    total = lambda n: F.sum(n) if n.startswith("n_") else money(F.sum(n))
    return ledger_rows(ledger, names, start, end).groupBy(*by).agg(*[total(n).alias(n) for n in names])


def ledger_long(sums: DataFrame, names, keys) -> DataFrame:
    """Wide sums -> (keys, stream, value), without the streams a key lacks."""
    pairs = F.array(*[F.struct(F.lit(n).alias("stream"), dbl(n).alias("value")) for n in names])
    return sums.select(*keys, F.inline(pairs)).where(F.col("value").isNotNull())


def with_grand_total(per_user: DataFrame, count: str, total: DataFrame, name: str) -> DataFrame:
    """The grand total (a one-row frame with column ``name``, broadcast) beside
    the counts; 0 for users without a count."""
    j = per_user.crossJoin(F.broadcast(total.select(F.col(name).alias("_total"))))
    return j.withColumn(name, F.when(F.col(count) > 0, F.col("_total")).otherwise(F.lit(0))).drop("_total")


def card_tx_share(card_tx: DataFrame, status: str = "completed", start=None, end=None,
                  ts: str = "posted_at") -> DataFrame:
    """Per-user count plus the grand total on every row.  The grand total is a
    one-row aggregate broadcast to the per-user rows (no single-partition window)."""
    f = card_tx.where((F.col("status") == status) & in_window(ts, start, end))
    per = f.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_tx_count"))
    tot = per.agg(F.sum("user_tx_count").alias("total_tx_count"))
    return per.crossJoin(F.broadcast(tot))


def join_revenue_streams(base: DataFrame, streams: list[DataFrame], key: str = "user_id") -> DataFrame:
    """Left-join pre-aggregated per-user streams to the base; numeric gaps -> 0,
    text and timestamps stay null."""
    j = reduce(lambda acc, s: acc.join(s, key, "left"), streams, base)
    base_cols = set(base.columns)
    fills = {}
    for fld in j.schema.fields:
        if fld.name in base_cols:
            continue
        if isinstance(fld.dataType, T.NumericType):
            fills[fld.name] = F.coalesce(F.col(fld.name), F.lit(0).cast(fld.dataType))
    return j.withColumns(fills)


def prorata_allocation(df: DataFrame, invoice_total: float, count: str = "user_tx_count",
                       total: str = "total_tx_count") -> Column:
    """invoice_total * user count / total count; 0 when there is no total."""
    return F.when(F.coalesce(F.col(total), F.lit(0)) > 0,
                  fine(F.lit(float(invoice_total)) * dbl(count) / dbl(total))).otherwise(
        F.lit(0).cast("decimal(30,10)"))


def user_profit(joined: DataFrame, fx: DataFrame, invoice_total: float = DEFAULT_INVOICE_USD,
                kyc_cost: float = KYC_COST_USD) -> DataFrame:
    """Net revenue per user.  ``fx`` is a one-row frame with column fx_rate
    (broadcast: the size is fixed at one row)."""
    j = joined.crossJoin(F.broadcast(fx.select("fx_rate")))
    on_usd = money(fine(safe_div("onramp_revenue_brl", "fx_rate")) + F.col("onramp_revenue_usdc"))
    off_usd = money(fine(safe_div("offramp_revenue_brl", "fx_rate")) + F.col("offramp_revenue_usdc"))
    j = j.withColumns({
        "card_cost_allocated_usd": prorata_allocation(j, invoice_total),
        "onramp_revenue_usd": on_usd,
        "offramp_revenue_usd": off_usd,
        "kyc_cost_usd": F.lit(str(kyc_cost)).cast("decimal(10,2)"),
    })
    # Each step is cast back to 28 digits so the decimal never loses scale.
    net = reduce(lambda acc, t: money(acc + t[1] if t[0] > 0 else acc - t[1]), [
        (1, F.col("offramp_revenue_usd")), (1, F.col("card_fee_usd")), (1, F.col("card_tx_fee_usd")),
        (1, F.col("swap_fee_usd")), (-1, F.col("cashback_usd")), (-1, F.col("revenue_share_paid_usd")),
        (-1, F.col("card_cost_allocated_usd")), (-1, F.col("kyc_cost_usd"))], F.col("onramp_revenue_usd"))
    return j.withColumn("net_revenue_usd", net).drop("fx_rate")


# ------------------------------------------------------------- user reports
def revenue_leaderboard(master: DataFrame, n: int = 50) -> DataFrame:
    top = master.orderBy(F.col("net_revenue_usd").desc(), F.col("user_id").asc()).limit(n)
    return top.select(mask_user_id("user_id").alias("user_id"), "full_name", "acquisition_source",
                      "referral_code", dbl("net_revenue_usd").alias("net_revenue_usd"),
                      dbl("onramp_revenue_usd").alias("onramp_revenue_usd"),
                      dbl("offramp_revenue_usd").alias("offramp_revenue_usd"),
                      dbl("card_fee_usd").alias("card_fee_usd"), dbl("cashback_usd").alias("cashback_usd"),
                      dbl("card_cost_allocated_usd").alias("card_cost_allocated_usd"),
                      F.col("n_conversions"))


PRODUCTS = ("has_conversion", "has_card", "has_swap", "has_crossborder")


def product_flags(master: DataFrame) -> dict[str, Column]:
    """Whether a user of the master table uses a product."""
    return {
        "has_conversion": F.col("n_conversions") > 0,
        "has_onramp": F.col("onramp_volume_brl") > 0,
        "has_offramp": F.col("offramp_volume_usdc") > 0,
        "has_card": (F.col("card_fee_usd") > 0) | (F.col("card_tx_fee_usd") > 0),
        "has_swap": F.col("n_swaps") > 0,
        "has_crossborder": F.col("payout_fee_usd") > 0 if "payout_fee_usd" in master.columns else F.lit(False),
    }


def n_products(master: DataFrame) -> Column:
    """Number of the four products that a user of the master table uses."""
    flags = product_flags(master)
    return reduce(lambda a, b: a + b, [flags[p].cast("bigint") for p in PRODUCTS])


def product_adoption(master: DataFrame, mask: bool = True) -> DataFrame:
    """Per user: product flags and the number of the four products used."""
    uid = mask_user_id("user_id") if mask else F.col("user_id")
    return master.select(uid.alias("user_id"), *[v.alias(k) for k, v in product_flags(master).items()],
                         n_products(master).alias("n_products"))


def product_adoption_rates(adoption: DataFrame) -> DataFrame:
    """Share of users per product (long rows)."""
    rows = adoption.agg(*[r6(F.avg(F.col(p).cast("double"))).alias(p) for p in
                          ("has_conversion", "has_onramp", "has_offramp", "has_card", "has_swap",
                           "has_crossborder")])
    return rows.select(F.inline(F.array(*[F.struct(F.lit(p).alias("product"), F.col(p).alias("pct_users"))
                                          for p in rows.columns])))


def n_products_distribution(adoption: DataFrame) -> DataFrame:
    return adoption.groupBy("n_products").agg(F.count(F.lit(1)).alias("n_users"))


def activation_funnel(master: DataFrame, revenue_generating: DataFrame) -> DataFrame:
    """Stages total -> KYC >= 1 -> revenue-generating, with step and overall rates."""
    base = master.agg(F.count(F.lit(1)).alias("total_users"),
                      F.count_if(F.coalesce(F.col("kyc_level"), F.lit(0)) >= 1).alias("kyc_done"))
    row = base.crossJoin(F.broadcast(revenue_generating.select(
        F.col("revenue_generating_count").alias("active_users"))))
    stages = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("total_users").alias("stage"), F.col("total_users").alias("n"),
                 F.lit(None).cast("bigint").alias("prev")),
        F.struct(F.lit(2).alias("step"), F.lit("kyc_done").alias("stage"), F.col("kyc_done").alias("n"),
                 F.col("total_users").alias("prev")),
        F.struct(F.lit(3).alias("step"), F.lit("active_users").alias("stage"), F.col("active_users").alias("n"),
                 F.col("kyc_done").alias("prev")))
    s = row.select(F.col("total_users").alias("_tot"), F.inline(stages))
    return s.select(F.col("step").cast("bigint").alias("step"), "stage", F.col("n").cast("bigint").alias("n"),
                    r6(safe_div("n", "prev")).alias("step_rate"),
                    r6(safe_div("n", "_tot")).alias("overall_rate"))


def acquisition_summary(master: DataFrame) -> DataFrame:
    tr = F.col("net_revenue_usd") > 0
    agg = master.groupBy("acquisition_source").agg(
        F.count("user_id").alias("n_users"),
        F.count_if(tr).alias("n_transacting"),
        r6(safe_div(F.sum("net_revenue_usd"), F.count("net_revenue_usd"))).alias("avg_net_revenue_usd"),
        dbl(F.sum("net_revenue_usd")).alias("total_net_revenue_usd"),
        r6(safe_div(F.count_if(tr), F.count(F.lit(1)))).alias("conversion_rate"))
    med = exact_percentiles(master, "net_revenue_usd", {"median_net_revenue_usd": 0.5}, ["acquisition_source"],
                           materialize=True)
    return agg.join(med, ["acquisition_source"], "left").withColumn(
        "median_net_revenue_usd", r6("median_net_revenue_usd"))


def referral_code_summary(master: DataFrame) -> DataFrame:
    m = master.where(F.col("referral_code").isNotNull() & (F.col("referral_code") != ""))
    g = m.groupBy("referral_code", "referral_code_name", "commission_rate_bps").agg(
        F.count("user_id").alias("n_users"),
        (F.sum("net_revenue_usd") / F.count("net_revenue_usd")).alias("_avg"))
    avg = dbl("_avg")
    comm = F.greatest(avg * dbl("commission_rate_bps") / F.lit(10000.0), F.lit(0.0))
    return g.select("referral_code", "referral_code_name", "commission_rate_bps", "n_users",
                    r6(avg).alias("avg_net_revenue_usd"), r6(comm).alias("avg_commission_cost_usd"),
                    r6(avg - comm).alias("net_arpu_after_commission"))


def founders_report(master: DataFrame) -> DataFrame:
    """Founders by net revenue, revenue per network member; products are counted
    in the founder's own row of the master table."""
    f = master.where(F.col("is_founder")).withColumn("n_products", n_products(master))
    return f.select(
        "user_id", "full_name", "referral_code", "founder_number", "founder_network_size",
        "invites_remaining", dbl("net_revenue_usd").alias("net_revenue_usd"),
        F.coalesce(F.col("n_products"), F.lit(0)).cast("bigint").alias("n_products"),
        r6(F.when(F.coalesce(F.col("founder_network_size"), F.lit(0)) > 0,
                  safe_div("net_revenue_usd", "founder_network_size"))).alias("revenue_per_network_member"))


def underused_invites(master: DataFrame, n: int = 20) -> DataFrame:
    f = master.where(F.col("is_founder") & (F.col("invites_remaining") > 0))
    return (f.orderBy(F.col("invites_remaining").desc(), F.col("user_id").asc()).limit(n)
            .select("user_id", "founder_number", "invites_remaining", "founder_network_size"))


def at_risk_users(master: DataFrame, min_revenue_usd: float = 0.0, lo: int = 30, hi: int = 90) -> DataFrame:
    m = master.where(F.col("days_since_last_active").between(lo, hi)
                     & (dbl("net_revenue_usd") >= F.lit(float(min_revenue_usd))))
    return m.select("user_id", "full_name", "referral_code", "acquisition_source", "days_since_last_active",
                    dbl("net_revenue_usd").alias("net_revenue_usd"),
                    dbl("onramp_revenue_usd").alias("onramp_revenue_usd"), "n_conversions",
                    F.round("tenure_months", 6).alias("tenure_months"))


def revenue_totals(master: DataFrame) -> DataFrame:
    return master.agg(dbl(nz(F.sum("card_fee_usd"))).alias("card_fee_usd"),
                      dbl(nz(F.sum("card_tx_fee_usd"))).alias("card_tx_fee_usd"),
                      dbl(nz(F.sum("net_revenue_usd"))).alias("net_revenue_usd"))


def daily_signups(users: DataFrame, ts: str = "created_at", start=None, end=None) -> DataFrame:
    u = users.where(F.col(ts).isNotNull() & in_window(ts, start, end))
    return u.groupBy(F.to_date(ts).alias("signup_date")).agg(F.count(F.lit(1)).alias("new_signups"))


def activity_kpis(users: DataFrame, as_of: str) -> DataFrame:
    """Users active in the 1, 7 and 30 days before ``as_of`` (exclusive)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    u = users.where((F.col("status") != "suspended") & (F.col("last_active_at") < now))
    return u.agg(*[F.count_if(F.col("last_active_at") >= now - F.expr(f"INTERVAL {d} DAYS")).alias(n)
                   for n, d in (("dau", 1), ("wau", 7), ("mau", 30))])


def signups_24h(users: DataFrame, as_of: str) -> DataFrame:
    """Signups in the 24 hours before ``as_of`` (exclusive)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = (F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("created_at") < now)
    return users.where(recent).agg(
        F.count(F.lit(1)).alias("new_signups_24h"))


def active_cards_summary(cards: DataFrame) -> DataFrame:
    """Active cards per variant plus a total row (rollup)."""
    a = cards.where(F.col("status") == "active")
    return (a.rollup("variant").agg(F.count(F.lit(1)).alias("n_cards"))
            .select(F.coalesce(F.col("variant"), F.lit("total")).alias("variant"), "n_cards"))


def referral_code_options(registrations: DataFrame, referral_codes: DataFrame) -> DataFrame:
    """Distinct codes that have attributed users."""
    rc = referral_codes.select("id", "code")
    return registrations.join(rc, F.col("attributed_referral_code_id") == F.col("id")).select("code").distinct()


def cumulative_profit_by_source(master: DataFrame) -> DataFrame:
    """Daily net revenue by signup day and source, running sum per source
    (the daily series is small: one row per (day, source))."""
    from pyspark.sql import Window
    d = master.groupBy(F.to_date("signup_date").alias("signup_date"), "acquisition_source").agg(
        F.sum("net_revenue_usd").alias("daily"))
    w = Window.partitionBy("acquisition_source").orderBy("signup_date").rowsBetween(
        Window.unboundedPreceding, 0)
    return d.select("signup_date", "acquisition_source", dbl("daily").alias("daily_net_revenue_usd"),
                    dbl(F.sum("daily").over(w)).alias("cumulative_net_revenue_usd"))


# --------------------------------------------------------------- set ops
def distinct_users(sources: list[DataFrame], user: str = "user_id") -> DataFrame:
    parts = [s.select(F.col(user).cast("string").alias("user_id")) for s in sources]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def revenue_generating_count(sources: list[DataFrame]) -> DataFrame:
    """UNION (distinct) of user ids over the activity sources, counted once."""
    parts = [s.select(F.col("user_id").cast("string").alias("user_id")) for s in sources]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.agg(F.count_distinct("user_id").alias("revenue_generating_count"))


def daily_activity(sources: list[DataFrame]) -> DataFrame:
    """Distinct (user, day) over a UNION ALL of (user_id, activity_ts) sources."""
    parts = [s.select(F.col("user_id"), F.to_date("activity_ts").alias("activity_date")) for s in sources]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
