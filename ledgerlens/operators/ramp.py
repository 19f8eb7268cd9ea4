"""On/off-ramp metrics: conversions, PIX flows, FX, volumes, revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.calendar import in_window, period_start, week_ending_monday
from ..functions.money import dbl, fine, nz, r6, safe_div
from ..functions.quantiles import exact_percentiles

# Direction labels that count as the on-ramp side.
ONRAMP_DIRECTIONS = ("brl_to_usdc", "buy", "onramp")
OFFRAMP_DIRECTIONS = ("usdc_to_brl", "sell", "offramp")
# Deposit states treated as settled money.
SETTLED_STATES = ("completed", "settled", "confirmed")


# ---------------------------------------------------------------- scans
def scan_window(df: DataFrame, ts: str, start: str | None = None, end: str | None = None,
                pred: Column | None = None, cols: list[str] | None = None) -> DataFrame:
    """Rows with ``start <= ts < end(+1 day if a bare date)``, an optional
    predicate and a fixed projection.  Filters are on raw columns so they
    reach the parquet scan."""
    out = df.where(in_window(ts, start, end))
    if pred is not None:
        out = out.where(pred)
    return out.select(*cols) if cols else out


def scan_settled_inflows(deposits: DataFrame, start=None, end=None, state: str = "state",
                         ts: str = "created_at", states=SETTLED_STATES) -> DataFrame:
    return scan_window(deposits, ts, start, end, F.lower(F.col(state)).isin(*states))


def scan_settled_outflows(transfers: DataFrame, start=None, end=None, status: str = "status",
                          ts: str = "created_at") -> DataFrame:
    return scan_window(transfers, ts, start, end, F.col(status) == "completed",
                       ["id", "user_id", "pix_key_type", "status", "amount_brl", "fee_brl",
                        "net_amount_brl", "executed_at", "created_at"])


def scan_card_spend(card_tx: DataFrame, start: str | None = None, end: str | None = None,
                    ts: str = "posted_at", amount_cents: str = "amount_usd_cents",
                    status: str = "status", kind: str = "transaction_type") -> DataFrame:
    """Completed spend rows (not refunds) with a post time and a positive
    amount, cents -> USD, no user id; optional inclusive day bounds."""
    return (scan_window(card_tx, ts, start, end,
                        (F.col(status) == "completed") & (F.col(kind) == "spend") & F.col(ts).isNotNull()
                        & (F.col(amount_cents) > 0))
            .select(F.col(ts).alias("posted_at"),
                    (F.col(amount_cents).cast("decimal(20,0)") * F.expr("0.01")).alias("amount_usd")))


def last_30d_filter(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Rows with ts >= max(ts) - days.  The max is a one-row aggregate that is
    broadcast to the scan (no driver round-trip)."""
    mx = df.agg(F.max(ts).alias("_mx"))
    return (df.join(F.broadcast(mx), how="cross")
            .where(F.col(ts) >= F.col("_mx") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_mx"))


# ------------------------------------------------------------ derived columns
def side_of(direction: Column) -> Column:
    return F.when(F.lower(direction).isin(*ONRAMP_DIRECTIONS), "onramp").otherwise("offramp")


def normalize_conversions(conv: DataFrame) -> DataFrame:
    """volume = |from| + |to| per currency, revenue = fee + spread (null -> 0),
    side = onramp for the known on-ramp directions, else offramp."""
    return conv.select(
        "*",
        (F.abs(nz("from_amount_brl")) + F.abs(nz("to_amount_brl"))).alias("volume_brl"),
        (F.abs(nz("from_amount_usdc")) + F.abs(nz("to_amount_usdc"))).alias("volume_usdc"),
        (nz("fee_amount_brl") + nz("spread_revenue_brl")).alias("revenue_brl"),
        (nz("fee_amount_usdc") + nz("spread_revenue_usdc")).alias("revenue_usdc"),
        side_of(F.col("direction")).alias("side"))


def conversion_revenue_usd(rate: str = "exchange_rate") -> Column:
    """(fee+spread) in BRL at the row's own rate (0 -> null) plus (fee+spread) in USDC."""
    brl = nz("fee_amount_brl") + nz("spread_revenue_brl")
    usdc = nz("fee_amount_usdc") + nz("spread_revenue_usdc")
    return nz(fine(safe_div(brl, F.nullif(F.col(rate), F.lit(0))))) + usdc


def implied_fx(direction: str = "direction") -> Column:
    d = F.lower(F.col(direction))
    return (F.when(d.isin(*ONRAMP_DIRECTIONS) & (F.col("to_amount_usdc") > 0),
                   safe_div("from_amount_brl", "to_amount_usdc"))
            .when(d.isin(*OFFRAMP_DIRECTIONS) & (F.col("from_amount_usdc") > 0),
                  safe_div("to_amount_brl", "from_amount_usdc")))


def spread_rows(norm: DataFrame) -> DataFrame:
    return (norm.where(F.col("spread_percentage").isNotNull())
            .select("side", dbl("spread_percentage").alias("spread_percentage"),
                    dbl("volume_brl").alias("volume_brl")))


# ---------------------------------------------------------------- aggregates
def ramp_kpis(norm: DataFrame) -> DataFrame:
    """Totals and per-side totals as one row (conditional aggregates: one pass)."""
    aggs = [F.count(F.lit(1)).alias("total_conversions"),
            F.count_distinct("user_id").alias("unique_users"),
            dbl(F.sum("volume_brl")).alias("volume_brl"),
            dbl(F.sum("volume_usdc")).alias("volume_usdc"),
            dbl(F.sum("revenue_brl")).alias("revenue_brl"),
            dbl(F.sum("revenue_usdc")).alias("revenue_usdc")]
    for s in ("onramp", "offramp"):
        on = F.col("side") == s
        aggs += [F.count_if(on).alias(f"{s}_conversions"),
                 dbl(nz(F.sum(F.when(on, F.col("volume_brl"))))).alias(f"{s}_volume_brl"),
                 dbl(nz(F.sum(F.when(on, F.col("volume_usdc"))))).alias(f"{s}_volume_usdc"),
                 dbl(nz(F.sum(F.when(on, F.col("revenue_brl"))))).alias(f"{s}_revenue_brl")]
    return norm.agg(*aggs)


def volume_by_period(norm: DataFrame, freq: str = "D", ts: str = "created_at") -> DataFrame:
    return (norm.where(F.col(ts).isNotNull())
            .groupBy(period_start(ts, freq).alias("period"), "side")
            .agg(dbl(F.sum("volume_brl")).alias("volume_brl"),
                 dbl(F.sum("volume_usdc")).alias("volume_usdc"),
                 F.count("direction").alias("n_conversions")))


def conv_daily_pivot(norm: DataFrame, ts: str = "created_at") -> DataFrame:
    """Daily BRL volume, one column per side (explicit value list), missing -> 0."""
    return (norm.where(F.col(ts).isNotNull())
            .groupBy(F.to_date(ts).alias("date"))
            .agg(dbl(nz(F.sum(F.when(F.col("side") == "offramp", F.col("volume_brl"))))).alias("offramp"),
                 dbl(nz(F.sum(F.when(F.col("side") == "onramp", F.col("volume_brl"))))).alias("onramp")))


def resample_volume(daily: DataFrame, freq: str, date: str = "date",
                    value_cols: tuple[str, ...] = ("onramp", "offramp")) -> DataFrame:
    """Daily -> weekly (right-closed, labelled by the Monday ending it) or monthly
    sums, including empty buckets between the first and last bucket."""
    f = freq.upper()
    bucket = week_ending_monday(date) if f.startswith("W") else F.trunc(F.col(date), "month")
    step = "INTERVAL 7 DAYS" if f.startswith("W") else "INTERVAL 1 MONTH"
    sums = daily.groupBy(bucket.alias("period")).agg(
        *[dbl(F.sum(fine(c))).alias(c) for c in value_cols])
    spine = (sums.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
             .where(F.col("lo").isNotNull())
             .select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias("period")))
    return (spine.join(sums, "period", "left")
            .select("period", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in value_cols]))


def fx_stats(norm: DataFrame, freq: str = "D", ts: str = "created_at") -> DataFrame:
    """Mean, p10, p90 (linear interpolation) and count of the implied rate."""
    fx = implied_fx()
    rows = (norm.where(F.col(ts).isNotNull())
            .select(period_start(ts, freq).alias("period"), "side", fx.alias("fx")))
    basic = rows.groupBy("period", "side").agg(r6(F.avg("fx")).alias("fx_mean"), F.count("fx").alias("n"))
    pct = exact_percentiles(rows, "fx", {"fx_p10": 0.1, "fx_p90": 0.9}, ["period", "side"])
    return basic.join(pct, ["period", "side"], "left").select(
        "period", "side", "fx_mean", r6("fx_p10").alias("fx_p10"), r6("fx_p90").alias("fx_p90"), "n")


def fx_rate_median(conv: DataFrame, start=None, end=None, default: float = 5.80,
                   rate: str = "effective_rate") -> DataFrame:
    """Median on-ramp effective rate over the window; ``default`` when empty."""
    sel = scan_window(conv, "created_at", start, end,
                      (F.col("used") == F.lit(True)) & (F.col("direction") == "brl_to_usdc"))
    med = exact_percentiles(sel, rate, {"m": 0.5})
    return med.select(F.coalesce(r6("m"), F.lit(default)).alias("fx_rate"))


def revenue_by_direction(norm: DataFrame, ts: str = "created_at") -> DataFrame:
    """Monthly fee, spread, count and total revenue (BRL) by side."""
    return (norm.where(F.col(ts).isNotNull())
            .groupBy(F.trunc(F.to_date(ts), "month").alias("month"), "side")
            .agg(dbl(F.sum(nz("fee_amount_brl"))).alias("fee_brl"),
                 dbl(F.sum(nz("spread_revenue_brl"))).alias("spread_brl"),
                 F.count("direction").alias("n_conversions"),
                 dbl(F.sum(nz("fee_amount_brl")) + F.sum(nz("spread_revenue_brl"))).alias("total_revenue_brl")))


def revenue_monthly(conv: DataFrame, ts: str = "created_at", rate: str = "exchange_rate") -> DataFrame:
    """Monthly fee/spread in BRL and in USD at each row's own rate."""
    r = F.nullif(F.col(rate), F.lit(0))
    fee_usd = nz(fine(safe_div(nz("fee_amount_brl"), r))) + nz("fee_amount_usdc")
    spread_usd = nz(fine(safe_div(nz("spread_revenue_brl"), r))) + nz("spread_revenue_usdc")
    return (conv.groupBy(F.trunc(F.to_date(ts), "month").alias("month"))
            .agg(dbl(F.sum("fee_amount_brl")).alias("fee_brl"),
                 dbl(F.sum("spread_revenue_brl")).alias("spread_brl"),
                 dbl(F.sum(fee_usd)).alias("fee_usd"),
                 dbl(F.sum(spread_usd)).alias("spread_usd"),
                 dbl(nz(F.sum("fee_amount_brl")) + nz(F.sum("spread_revenue_brl"))).alias("total_revenue_brl")))


def card_daily(spend: DataFrame, ts: str = "posted_at", amount: str = "amount_usd") -> DataFrame:
    return (spend.groupBy(F.to_date(ts).alias("date"))
            .agg(dbl(F.sum(amount)).alias("amount_usd"), F.count(amount).alias("n_txns")))


def pix_daily(deposits: DataFrame, transfers: DataFrame, amount: str = "amount_brl",
              ts: str = "created_at") -> DataFrame:
    """Daily in / out / net: two daily aggregates, full outer join on the day."""
    din = deposits.groupBy(F.to_date(ts).alias("date")).agg(F.sum(amount).alias("pix_in"))
    dout = transfers.groupBy(F.to_date(ts).alias("date")).agg(F.sum(amount).alias("pix_out"))
    j = din.join(dout, "date", "full_outer")
    return j.select("date", dbl(nz("pix_in")).alias("pix_in"), dbl(nz("pix_out")).alias("pix_out"),
                    dbl(nz("pix_in") - nz("pix_out")).alias("pix_net"))


def active_daily(sources: dict[str, DataFrame], in_source: str = "deposits",
                 out_source: str = "transfers", user: str = "user_id",
                 ts: str = "created_at") -> DataFrame:
    """Distinct users per day over every source, plus in-only and out-only
    counts: flags per day and user first, then counts per day, so no row is
    expanded for the distinct counts."""
    parts = [df.select(F.to_date(ts).alias("date"), F.col(user).cast("string").alias("user_id"),
                       F.lit(name).alias("src"))
             for name, df in sources.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    users = u.where(F.col("date").isNotNull()).groupBy("date", "user_id").agg(
        F.bool_or(F.col("src") == in_source).alias("_in"), F.bool_or(F.col("src") == out_source).alias("_out"))
    known = F.col("user_id").isNotNull()
    return users.groupBy("date").agg(F.count("user_id").alias("active_total"),
                                     F.count_if(F.col("_in") & known).alias("active_in"),
                                     F.count_if(F.col("_out") & known).alias("active_out"))


def active_users(df: DataFrame, freq: str = "M", ts: str = "created_at", user: str = "user_id",
                 approx: bool = False) -> DataFrame:
    cnt = F.approx_count_distinct(user) if approx else F.count_distinct(user)
    return (df.where(F.col(ts).isNotNull()).groupBy(period_start(ts, freq).alias("period"))
            .agg(cnt.alias("active_users")))


def user_behavior(norm: DataFrame, user: str = "user_id") -> DataFrame:
    """Two-level aggregate: per user counts, then global."""
    per = norm.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("unique_users"),
                   F.count_if(F.col("n") > 1).alias("repeat_users"),
                   r6(safe_div(F.count_if(F.col("n") > 1), F.count(F.lit(1)))).alias("repeat_rate"),
                   r6(safe_div(F.sum("n"), F.count(F.lit(1)))).alias("avg_conversions_per_user"))


def new_vs_returning(norm: DataFrame, ts: str = "created_at", user: str = "user_id") -> DataFrame:
    """Per month: conversions in the user's first month vs later months
    (counts rows, as the reference does), plus distinct-user counts.

    Rows are first combined to (user, month, n) map-side, so the per-user
    window only sees a user's months (bounded by the calendar), never a hot
    user's raw rows."""
    m = F.trunc(F.to_date(ts), "month")
    um = norm.groupBy(F.col(user).alias("user_id"), m.alias("month")).agg(F.count(F.lit(1)).alias("_n"))
    t = um.withColumn("first_month", F.min("month").over(Window.partitionBy("user_id")))
    new = F.col("month") == F.col("first_month")
    return (t.groupBy("month")
            .agg(F.sum(F.when(new, F.col("_n")).otherwise(F.lit(0))).alias("new_users"),
                 F.sum(F.when(~new, F.col("_n")).otherwise(F.lit(0))).alias("returning_users"),
                 F.count_if(new).alias("new_distinct_users"),
                 F.count_if(~new).alias("returning_distinct_users")))


def top_users(norm: DataFrame, n: int = 20, by: str = "volume_brl", user: str = "user_id") -> DataFrame:
    """Per-user sums, top ``n`` by the chosen metric (user id breaks ties)."""
    per = norm.groupBy(user).agg(
        dbl(F.sum("volume_brl")).alias("volume_brl"),
        dbl(F.sum("volume_usdc")).alias("volume_usdc"),
        dbl(F.sum("revenue_brl")).alias("revenue_brl"),
        F.count("direction").alias("n_conversions"))
    return per.orderBy(F.col(by).desc(), F.col(user).asc()).limit(n)


def deposit_cohort_retention(deposits: DataFrame, user: str = "user_id",
                             ts: str = "created_at") -> DataFrame:
    """First-deposit-month cohorts; share of the cohort active in each later
    month (long format: cohort_month, offset, label M+n, users, retention)."""
    d = deposits.where(F.col(ts).isNotNull()).select(
        F.col(user).cast("string").alias("user_id"), F.trunc(F.to_date(ts), "month").alias("month"))
    firsts = d.groupBy("user_id").agg(F.min("month").alias("cohort_month"))
    act = d.distinct().join(firsts, "user_id")
    off = (F.year("month") * 12 + F.month("month")) - (F.year("cohort_month") * 12 + F.month("cohort_month"))
    cells = act.groupBy("cohort_month", off.cast("bigint").alias("month_offset")).agg(
        F.count(F.lit(1)).alias("active_users"))
    sizes = firsts.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    return (cells.join(sizes, "cohort_month")
            .select("cohort_month", "month_offset",
                    F.concat(F.lit("M+"), F.col("month_offset").cast("string")).alias("label"),
                    "active_users", "cohort_size",
                    r6(safe_div("active_users", "cohort_size")).alias("retention")))


def ramp_summary(conv: DataFrame, deposits: DataFrame, transfers: DataFrame, as_of: str,
                 rate: str = "exchange_rate", ts: str = "created_at") -> DataFrame:
    """The 18 named (metric, value) rows: one conditional aggregate per input,
    cross-joined (each side is one row) and unpivoted with ``stack``."""
    dep = deposits.agg(nz(F.sum("amount_brl")).alias("pix_in"),
                       F.sum("amount_brl").alias("_s"), F.count("amount_brl").alias("_n"),
                       F.count_distinct("user_id").alias("unique_in"))
    trf = transfers.agg(nz(F.sum("amount_brl")).alias("pix_out"),
                        F.sum("amount_brl").alias("_so"), F.count("amount_brl").alias("_no"),
                        F.count_distinct("user_id").alias("unique_out"))
    on = F.lower(F.col("direction")).isin(*ONRAMP_DIRECTIONS)
    r = F.nullif(F.col(rate), F.lit(0))
    vol_usd = F.when(on, nz(fine(safe_div(nz("from_amount_brl"), r)))).otherwise(
        nz(fine(safe_div(nz("to_amount_brl"), r))))
    rev_brl = nz("fee_amount_brl") + nz("spread_revenue_brl")
    rev_usdc = nz("fee_amount_usdc") + nz("spread_revenue_usdc")
    rev_usd = nz(fine(safe_div(rev_brl, r))) + rev_usdc
    now = F.lit(as_of).cast("timestamp_ntz")
    l30 = (F.col(ts) >= now - F.expr("INTERVAL 30 DAYS")) & (F.col(ts) < now)
    cv = conv.agg(
        F.count(F.lit(1)).alias("total_conversions"),
        F.count_distinct("user_id").alias("unique_conv_users"),
        nz(F.sum(F.when(on, F.col("from_amount_brl")))).alias("onramp_brl"),
        nz(F.sum(F.when(~on, F.col("to_amount_brl")))).alias("offramp_brl"),
        nz(F.sum(rev_brl)).alias("revenue_brl"),
        nz(F.sum(rev_usdc)).alias("revenue_usdc"),
        nz(F.sum(vol_usd)).alias("volume_usd"),
        F.count_if(l30).alias("conv_l30"),
        nz(F.sum(F.when(l30, vol_usd))).alias("volume_usd_l30"),
        nz(F.sum(F.when(l30, rev_usd))).alias("revenue_usd_l30"),
        nz(F.sum(rev_usd)).alias("revenue_usd"))
    row = dep.crossJoin(trf).crossJoin(cv)
    # The labels of the summary.
    metrics = [
        ("PIX IN (dep)", dbl("pix_in")),
        ("PIX OUT (transf)", dbl("pix_out")),
        ("PIX NET", dbl(F.col("pix_in") - F.col("pix_out"))),
        ("Avg ticket IN (BRL)", F.coalesce(safe_div("_s", "_n"), F.lit(0.0))),
        ("Avg ticket OUT (BRL)", F.coalesce(safe_div("_so", "_no"), F.lit(0.0))),
        ("Unique users IN", dbl("unique_in")),
        ("Unique users OUT", dbl("unique_out")),
        ("Total conversions", dbl("total_conversions")),
        ("Unique conversion users", dbl("unique_conv_users")),
        ("Onramp volume BRL", dbl("onramp_brl")),
        ("Offramp volume BRL", dbl("offramp_brl")),
        ("Total revenue BRL", dbl("revenue_brl")),
        ("Total revenue USDC", dbl("revenue_usdc")),
        ("Total volume USD", dbl("volume_usd")),
        ("Total conversions L30", dbl("conv_l30")),
        ("Total volume USD L30", dbl("volume_usd_l30")),
        ("Total revenue USD L30", dbl("revenue_usd_l30")),
        ("Total revenue USD", dbl("revenue_usd")),
    ]
    arr = F.array(*[F.struct(F.lit(k).alias("metric"), r6(v).alias("value")) for k, v in metrics])
    return row.select(F.inline(arr))
