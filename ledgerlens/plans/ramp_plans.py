"""Ramp queries bound to the generated tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import scale_minor_units
from ..operators import ramp, users
from ..sources.binding import AS_OF, FULL_END, FULL_START, Bound, once
from .oracle_views import register, with_views
from .registry import query

# Per-row USD value of BRL amounts at the row's own rate (SQL side).
_USD = "CAST(CAST(({x}) / NULLIF(exchange_rate, 0) AS VARCHAR) AS DECIMAL(30,10))"


@once
def conversions(b: Bound):
    """Used conversions in the full window, real units."""
    return scale_minor_units(ramp.scan_window(b.conversion_quotes, "created_at", FULL_START, FULL_END,
                                              F.col("used") == F.lit(True)))


@once
def normalized(b: Bound):
    return ramp.normalize_conversions(conversions(b))


register("conv_used", """
    SELECT * FROM conversions
    WHERE TRUE AND used = TRUE""",
         ["conversions"])
register("norm_used", """
    SELECT *,
           abs(coalesce(from_amount_brl, 0)) + abs(coalesce(to_amount_brl, 0)) AS volume_brl,
           abs(coalesce(from_amount_usdc, 0)) + abs(coalesce(to_amount_usdc, 0)) AS volume_usdc,
           coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0) AS revenue_brl,
           coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0) AS revenue_usdc,
           CASE WHEN lower(direction) IN ('brl_to_usdc', 'buy', 'onramp') THEN 'onramp' ELSE 'offramp' END AS side
    FROM conv_used""", ["conv_used"])


def settled_deposits(b: Bound):
    return scale_minor_units(ramp.scan_settled_inflows(b.pix_deposits, FULL_START, FULL_END))


def completed_transfers(b: Bound):
    return scale_minor_units(ramp.scan_settled_outflows(b.pix_transfers, FULL_START, FULL_END))


register("dep_settled", """
    SELECT id, user_id, state, provider_name, TRY_CAST(amount_brl AS DECIMAL(20,0)) * 0.01 AS amount_brl, created_at
    FROM pix_deposits WHERE TRUE
      AND lower(state) IN ('completed', 'settled', 'confirmed')""", ["pix_deposits"])
register("trf_completed", """
    SELECT id, user_id, pix_key_type, status, TRY_CAST(amount_brl AS DECIMAL(20,0)) * 0.01 AS amount_brl,
           TRY_CAST(fee_brl AS DECIMAL(20,0)) * 0.01 AS fee_brl,
           TRY_CAST(net_amount_brl AS DECIMAL(20,0)) * 0.01 AS net_amount_brl, executed_at, created_at
    FROM pix_transfers WHERE TRUE
      AND status = 'completed'""", ["pix_transfers"])


def card_spend(b: Bound):
    return ramp.scan_card_spend(b.card_transactions, FULL_START, FULL_END)


register("card_spend", """
    SELECT posted_at, CAST(amount_usd_cents AS DECIMAL(20,0)) * 0.01 AS amount_usd FROM card_transactions
    WHERE TRUE
      AND status = 'completed' AND transaction_type = 'spend' AND posted_at IS NOT NULL
      AND amount_usd_cents > 0""", ["card_transactions"])


# ------------------------------------------------------------------ scans
@query("scan_window", with_views("""
    SELECT id, user_id, created_at, direction, from_amount_brl, to_amount_usdc
    FROM conversion_quotes
    WHERE created_at >= TIMESTAMP '1996-03-01' AND created_at < TIMESTAMP '1997-07-01' AND used = TRUE""",
                                 "conversion_quotes"))
def _scan_window(b: Bound):
    return ramp.scan_window(b.conversion_quotes, "created_at", "1996-03-01", "1997-06-30",
                            F.col("used") == F.lit(True),
                            ["id", "user_id", "created_at", "direction", "from_amount_brl", "to_amount_usdc"])


@query("scan_settled_inflows", with_views("""
    SELECT id, user_id, state, provider_name, CAST(amount_brl AS DOUBLE) AS amount_brl, created_at
    FROM dep_settled""", "dep_settled"))
def _inflows(b: Bound):
    return settled_deposits(b).withColumn("amount_brl", F.col("amount_brl").cast("double"))


@query("scan_settled_outflows", with_views("""
    SELECT id, user_id, pix_key_type, status, CAST(amount_brl AS DOUBLE) AS amount_brl,
           CAST(fee_brl AS DOUBLE) AS fee_brl, CAST(net_amount_brl AS DOUBLE) AS net_amount_brl,
           executed_at, created_at FROM trf_completed""", "trf_completed"))
def _outflows(b: Bound):
    d = completed_transfers(b)
    return d.select(*[F.col(c).cast("double").alias(c) if c in ("amount_brl", "fee_brl", "net_amount_brl")
                      else F.col(c) for c in d.columns])


@query("scan_card_spend", with_views("""
    SELECT posted_at, CAST(amount_usd AS DOUBLE) AS amount_usd FROM card_spend""", "card_spend"))
def _card_spend(b: Bound):
    return card_spend(b).withColumn("amount_usd", F.col("amount_usd").cast("double"))


@query("scale_minor_units", with_views("""
    SELECT id, CAST(from_amount_brl AS DOUBLE) AS from_amount_brl, CAST(to_amount_brl AS DOUBLE) AS to_amount_brl,
           CAST(from_amount_usdc AS DOUBLE) AS from_amount_usdc, CAST(to_amount_usdc AS DOUBLE) AS to_amount_usdc,
           CAST(fee_amount_brl AS DOUBLE) AS fee_amount_brl, CAST(spread_revenue_usdc AS DOUBLE) AS spread_revenue_usdc
    FROM conversions""", "conversions"))
def _scale(b: Bound):
    q = b.conversion_quotes.select("id", "from_amount_brl", "to_amount_brl", "from_amount_usdc",
                                   "to_amount_usdc", "fee_amount_brl", "spread_revenue_usdc")
    s = scale_minor_units(q)
    return s.select("id", *[F.col(c).cast("double").alias(c) for c in s.columns if c != "id"])


# ------------------------------------------------------------ derived columns
@query("normalize_conversions", with_views("""
    SELECT id, side, CAST(volume_brl AS DOUBLE) AS volume_brl, CAST(volume_usdc AS DOUBLE) AS volume_usdc,
           CAST(revenue_brl AS DOUBLE) AS revenue_brl, CAST(revenue_usdc AS DOUBLE) AS revenue_usdc
    FROM norm_used""", "norm_used"))
def _normalize(b: Bound):
    n = normalized(b)
    return n.select("id", "side", *[F.col(c).cast("double").alias(c)
                                    for c in ("volume_brl", "volume_usdc", "revenue_brl", "revenue_usdc")])


@query("conversion_revenue_usd", with_views(f"""
    SELECT id, CAST(coalesce({_USD.format(x='coalesce(fee_amount_brl,0) + coalesce(spread_revenue_brl,0)')}, 0)
                    + coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0) AS DOUBLE) AS revenue_usd
    FROM conv_used""", "conv_used"))
def _rev_usd(b: Bound):
    return conversions(b).select("id", ramp.conversion_revenue_usd().cast("double").alias("revenue_usd"))


@query("implied_fx", with_views("""
    SELECT id, side, round(CASE
        WHEN lower(direction) IN ('brl_to_usdc','buy','onramp') AND to_amount_usdc > 0
             THEN CAST(from_amount_brl AS DOUBLE) / CAST(to_amount_usdc AS DOUBLE)
        WHEN lower(direction) IN ('usdc_to_brl','sell','offramp') AND from_amount_usdc > 0
             THEN CAST(to_amount_brl AS DOUBLE) / CAST(from_amount_usdc AS DOUBLE) END, 6) AS fx
    FROM norm_used""", "norm_used"))
def _implied_fx(b: Bound):
    return normalized(b).select("id", "side", F.round(ramp.implied_fx(), 6).alias("fx"))


@query("spread_rows", with_views("""
    SELECT side, CAST(spread_percentage AS DOUBLE) AS spread_percentage, CAST(volume_brl AS DOUBLE) AS volume_brl
    FROM norm_used WHERE spread_percentage IS NOT NULL""", "norm_used"))
def _spread_rows(b: Bound):
    return ramp.spread_rows(normalized(b))


@query("last_30d_filter", with_views("""
    SELECT id, user_id, created_at FROM conv_used
    WHERE created_at >= (SELECT max(created_at) FROM conv_used) - INTERVAL 30 DAY""", "conv_used"))
def _l30(b: Bound):
    return ramp.last_30d_filter(conversions(b).select("id", "user_id", "created_at"), "created_at")


# ---------------------------------------------------------------- aggregates
_SIDE_SUMS = ",\n".join(
    f"""CAST(count(*) FILTER (WHERE side = '{s}') AS BIGINT) AS {s}_conversions,
    CAST(coalesce(sum(volume_brl) FILTER (WHERE side = '{s}'), 0) AS DOUBLE) AS {s}_volume_brl,
    CAST(coalesce(sum(volume_usdc) FILTER (WHERE side = '{s}'), 0) AS DOUBLE) AS {s}_volume_usdc,
    CAST(coalesce(sum(revenue_brl) FILTER (WHERE side = '{s}'), 0) AS DOUBLE) AS {s}_revenue_brl"""
    for s in ("onramp", "offramp"))


@query("ramp_kpis", with_views(f"""
    SELECT count(*) AS total_conversions, count(DISTINCT user_id) AS unique_users,
           CAST(sum(volume_brl) AS DOUBLE) AS volume_brl, CAST(sum(volume_usdc) AS DOUBLE) AS volume_usdc,
           CAST(sum(revenue_brl) AS DOUBLE) AS revenue_brl, CAST(sum(revenue_usdc) AS DOUBLE) AS revenue_usdc,
           {_SIDE_SUMS}
    FROM norm_used""", "norm_used"))
def _kpis(b: Bound):
    return ramp.ramp_kpis(normalized(b))


@query("volume_by_period", with_views("""
    SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, side,
           CAST(sum(volume_brl) AS DOUBLE) AS volume_brl, CAST(sum(volume_usdc) AS DOUBLE) AS volume_usdc,
           count(direction) AS n_conversions
    FROM norm_used WHERE created_at IS NOT NULL GROUP BY 1, 2""", "norm_used"))
def _vbp(b: Bound):
    return ramp.volume_by_period(normalized(b), "M")


@query("volume_by_week", with_views("""
    SELECT CAST(date_trunc('week', created_at) AS DATE) AS period, side,
           CAST(sum(volume_brl) AS DOUBLE) AS volume_brl, CAST(sum(volume_usdc) AS DOUBLE) AS volume_usdc,
           count(direction) AS n_conversions
    FROM norm_used WHERE created_at IS NOT NULL GROUP BY 1, 2""", "norm_used"))
def _vbw(b: Bound):
    return ramp.volume_by_period(normalized(b), "W")


register("conv_daily", """
    SELECT CAST(created_at AS DATE) AS "date",
           CAST(coalesce(sum(volume_brl) FILTER (WHERE side = 'offramp'), 0) AS DOUBLE) AS offramp,
           CAST(coalesce(sum(volume_brl) FILTER (WHERE side = 'onramp'), 0) AS DOUBLE) AS onramp
    FROM norm_used WHERE created_at IS NOT NULL GROUP BY 1""", ["norm_used"])


@query("conv_daily_pivot", with_views("SELECT * FROM conv_daily", "conv_daily"))
def _cdp(b: Bound):
    return ramp.conv_daily_pivot(normalized(b))


@query("resample_volume", with_views("""
    WITH s AS (
        SELECT CAST(date_trunc('week', "date" - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE) AS period,
               CAST(sum(CAST(CAST(onramp AS VARCHAR) AS DECIMAL(30,10))) AS DOUBLE) AS onramp,
               CAST(sum(CAST(CAST(offramp AS VARCHAR) AS DECIMAL(30,10))) AS DOUBLE) AS offramp
        FROM conv_daily GROUP BY 1),
    sp AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE) AS period FROM s)
    SELECT sp.period, coalesce(s.onramp, 0.0) AS onramp, coalesce(s.offramp, 0.0) AS offramp
    FROM sp LEFT JOIN s ON sp.period = s.period""", "conv_daily"))
def _resample(b: Bound):
    return ramp.resample_volume(ramp.conv_daily_pivot(normalized(b)), "W")


@query("resample_volume_monthly", with_views("""
    WITH s AS (
        SELECT CAST(date_trunc('month', "date") AS DATE) AS period,
               CAST(sum(CAST(CAST(onramp AS VARCHAR) AS DECIMAL(30,10))) AS DOUBLE) AS onramp,
               CAST(sum(CAST(CAST(offramp AS VARCHAR) AS DECIMAL(30,10))) AS DOUBLE) AS offramp
        FROM conv_daily GROUP BY 1),
    sp AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM s)
    SELECT sp.period, coalesce(s.onramp, 0.0) AS onramp, coalesce(s.offramp, 0.0) AS offramp
    FROM sp LEFT JOIN s ON sp.period = s.period""", "conv_daily"))
def _resample_m(b: Bound):
    return ramp.resample_volume(ramp.conv_daily_pivot(normalized(b)), "M")


@query("fx_stats", with_views("""
    SELECT period, side, round(avg(fx), 6) AS fx_mean, round(quantile_cont(fx, 0.1), 6) AS fx_p10,
           round(quantile_cont(fx, 0.9), 6) AS fx_p90, count(fx) AS n
    FROM (SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, side, CASE
        WHEN lower(direction) IN ('brl_to_usdc','buy','onramp') AND to_amount_usdc > 0
             THEN CAST(from_amount_brl AS DOUBLE) / CAST(to_amount_usdc AS DOUBLE)
        WHEN lower(direction) IN ('usdc_to_brl','sell','offramp') AND from_amount_usdc > 0
             THEN CAST(to_amount_brl AS DOUBLE) / CAST(from_amount_usdc AS DOUBLE) END AS fx
          FROM norm_used WHERE created_at IS NOT NULL)
    GROUP BY 1, 2""", "norm_used"))
def _fx_stats(b: Bound):
    return ramp.fx_stats(normalized(b), "M")


@query("fx_rate_median", with_views("""
    SELECT coalesce(round(median(CAST(effective_rate AS DOUBLE)), 6), 5.8) AS fx_rate
    FROM conversions WHERE used = TRUE AND direction = 'brl_to_usdc'
      AND TRUE""", "conversions"))
def _fx_median(b: Bound):
    return ramp.fx_rate_median(scale_minor_units(b.conversion_quotes), FULL_START, FULL_END)


@query("revenue_by_direction", with_views("""
    SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, side,
           CAST(sum(coalesce(fee_amount_brl, 0)) AS DOUBLE) AS fee_brl,
           CAST(sum(coalesce(spread_revenue_brl, 0)) AS DOUBLE) AS spread_brl,
           count(direction) AS n_conversions,
           CAST(sum(coalesce(fee_amount_brl, 0)) + sum(coalesce(spread_revenue_brl, 0)) AS DOUBLE) AS total_revenue_brl
    FROM norm_used WHERE created_at IS NOT NULL GROUP BY 1, 2""", "norm_used"))
def _rev_dir(b: Bound):
    return ramp.revenue_by_direction(normalized(b))


@query("revenue_monthly", with_views(f"""
    SELECT CAST(date_trunc('month', created_at) AS DATE) AS month,
           CAST(sum(fee_amount_brl) AS DOUBLE) AS fee_brl, CAST(sum(spread_revenue_brl) AS DOUBLE) AS spread_brl,
           CAST(sum(coalesce({_USD.format(x='coalesce(fee_amount_brl, 0)')}, 0) + coalesce(fee_amount_usdc, 0)) AS DOUBLE) AS fee_usd,
           CAST(sum(coalesce({_USD.format(x='coalesce(spread_revenue_brl, 0)')}, 0) + coalesce(spread_revenue_usdc, 0)) AS DOUBLE) AS spread_usd,
           CAST(coalesce(sum(fee_amount_brl), 0) + coalesce(sum(spread_revenue_brl), 0) AS DOUBLE) AS total_revenue_brl
    FROM conv_used GROUP BY 1""", "conv_used"))
def _rev_monthly(b: Bound):
    return ramp.revenue_monthly(conversions(b))


@query("card_daily", with_views("""
    SELECT CAST(posted_at AS DATE) AS "date", CAST(sum(amount_usd) AS DOUBLE) AS amount_usd,
           count(amount_usd) AS n_txns FROM card_spend GROUP BY 1""", "card_spend"))
def _card_daily(b: Bound):
    return ramp.card_daily(card_spend(b))


@query("pix_daily", with_views("""
    WITH i AS (SELECT CAST(created_at AS DATE) AS d, sum(amount_brl) AS pix_in FROM dep_settled GROUP BY 1),
         o AS (SELECT CAST(created_at AS DATE) AS d, sum(amount_brl) AS pix_out FROM trf_completed GROUP BY 1)
    SELECT coalesce(i.d, o.d) AS "date", CAST(coalesce(pix_in, 0) AS DOUBLE) AS pix_in,
           CAST(coalesce(pix_out, 0) AS DOUBLE) AS pix_out,
           CAST(coalesce(pix_in, 0) - coalesce(pix_out, 0) AS DOUBLE) AS pix_net
    FROM i FULL OUTER JOIN o ON i.d = o.d""", "dep_settled", "trf_completed"))
def _pix_daily(b: Bound):
    return ramp.pix_daily(settled_deposits(b), completed_transfers(b))


def _activity_sources(b: Bound):
    return {
        "deposits": settled_deposits(b),
        "transfers": completed_transfers(b),
        # card transactions, paid fees, settled billing, swaps and completed payouts
        "ledger": users.ledger_rows(b.card_ledger, ("n_card_tx", "card_fee_usd", "billing_usd", "n_swaps", "payout_fee_usd"))
                       .select("user_id", F.col("ts").alias("created_at")),
    }


@query("active_daily", with_views("""
    WITH u AS (
        SELECT CAST(created_at AS DATE) AS d, CAST(user_id AS VARCHAR) AS u, 'deposits' AS src FROM dep_settled
        UNION ALL SELECT CAST(created_at AS DATE), CAST(user_id AS VARCHAR), 'transfers' FROM trf_completed
        UNION ALL SELECT CAST(posted_at AS DATE), CAST(user_id AS VARCHAR), 'card_tx' FROM card_transactions WHERE status = 'completed'
        UNION ALL SELECT CAST(created_at AS DATE), CAST(user_id AS VARCHAR), 'card_fees' FROM card_annual_fees WHERE status = 'paid'
        UNION ALL SELECT CAST(created_at AS DATE), CAST(user_id AS VARCHAR), 'billing' FROM billing_charges WHERE status = 'settled'
        UNION ALL SELECT CAST("timestamp" AS DATE), CAST(user_id AS VARCHAR), 'swaps' FROM swap_transactions
        UNION ALL SELECT CAST(created_at AS DATE), CAST(user_id AS VARCHAR), 'payouts' FROM payouts WHERE status = 'completed')
    SELECT d AS "date", count(DISTINCT u) AS active_total,
           count(DISTINCT u) FILTER (WHERE src = 'deposits') AS active_in,
           count(DISTINCT u) FILTER (WHERE src = 'transfers') AS active_out
    FROM u WHERE d IS NOT NULL GROUP BY 1""", "dep_settled", "trf_completed", "card_transactions",
                                     "card_annual_fees", "billing_charges", "swap_transactions", "payouts"))
def _active_daily(b: Bound):
    return ramp.active_daily(_activity_sources(b))


@query("active_users", with_views("""
    SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, count(DISTINCT user_id) AS active_users
    FROM conv_used WHERE created_at IS NOT NULL GROUP BY 1""", "conv_used"))
def _active_users(b: Bound):
    return ramp.active_users(conversions(b), "M")


@query("user_behavior", with_views("""
    SELECT count(*) AS unique_users, count(*) FILTER (WHERE n > 1) AS repeat_users,
           round(CAST(count(*) FILTER (WHERE n > 1) AS DOUBLE) / count(*), 6) AS repeat_rate,
           round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS avg_conversions_per_user
    FROM (SELECT user_id, count(*) AS n FROM norm_used GROUP BY user_id)""", "norm_used"))
def _behavior(b: Bound):
    return ramp.user_behavior(normalized(b))


@query("new_vs_returning", with_views("""
    SELECT month, count(*) FILTER (WHERE month = fm) AS new_users,
           count(*) FILTER (WHERE month <> fm) AS returning_users,
           count(DISTINCT user_id) FILTER (WHERE month = fm) AS new_distinct_users,
           count(DISTINCT user_id) FILTER (WHERE month <> fm) AS returning_distinct_users
    FROM (SELECT user_id, CAST(date_trunc('month', created_at) AS DATE) AS month,
                 min(CAST(date_trunc('month', created_at) AS DATE)) OVER (PARTITION BY user_id) AS fm
          FROM norm_used) GROUP BY month""", "norm_used"))
def _nvr(b: Bound):
    return ramp.new_vs_returning(normalized(b))


@query("top_users", with_views("""
    SELECT user_id, CAST(sum(volume_brl) AS DOUBLE) AS volume_brl, CAST(sum(volume_usdc) AS DOUBLE) AS volume_usdc,
           CAST(sum(revenue_brl) AS DOUBLE) AS revenue_brl, count(direction) AS n_conversions
    FROM norm_used GROUP BY user_id ORDER BY sum(volume_brl) DESC, user_id LIMIT 20""", "norm_used"))
def _top_users(b: Bound):
    return ramp.top_users(normalized(b), 20, "volume_brl")


@query("deposit_cohort_retention", with_views("""
    WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, CAST(date_trunc('month', created_at) AS DATE) AS month
               FROM dep_settled WHERE created_at IS NOT NULL),
         f AS (SELECT user_id, min(month) AS cohort_month FROM d GROUP BY 1),
         c AS (SELECT f.cohort_month,
                      CAST((year(d.month) * 12 + month(d.month)) - (year(f.cohort_month) * 12 + month(f.cohort_month)) AS BIGINT) AS month_offset,
                      count(*) AS active_users
               FROM d JOIN f USING (user_id) GROUP BY 1, 2),
         s AS (SELECT cohort_month, count(*) AS cohort_size FROM f GROUP BY 1)
    SELECT c.cohort_month, month_offset, 'M+' || CAST(month_offset AS VARCHAR) AS label, active_users, cohort_size,
           round(CAST(active_users AS DOUBLE) / cohort_size, 6) AS retention
    FROM c JOIN s USING (cohort_month)""", "dep_settled"))
def _dep_cohort(b: Bound):
    return ramp.deposit_cohort_retention(settled_deposits(b))


register("summary", f"""
    WITH dep AS (SELECT coalesce(sum(amount_brl), 0) AS pix_in, CAST(sum(amount_brl) AS DOUBLE) / NULLIF(count(amount_brl), 0) AS avg_in,
                        count(DISTINCT user_id) AS unique_in FROM dep_settled),
         trf AS (SELECT coalesce(sum(amount_brl), 0) AS pix_out, CAST(sum(amount_brl) AS DOUBLE) / NULLIF(count(amount_brl), 0) AS avg_out,
                        count(DISTINCT user_id) AS unique_out FROM trf_completed),
         r AS (SELECT *, lower(direction) IN ('brl_to_usdc','buy','onramp') AS on_,
                      created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND created_at < TIMESTAMP '{AS_OF}' AS l30,
                      coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0) AS rb,
                      coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0) AS ru FROM conv_used),
         r2 AS (SELECT *, CASE WHEN on_ THEN coalesce({_USD.format(x='coalesce(from_amount_brl, 0)')}, 0)
                               ELSE coalesce({_USD.format(x='coalesce(to_amount_brl, 0)')}, 0) END AS vu,
                          coalesce({_USD.format(x='rb')}, 0) + ru AS revu FROM r),
         cv AS (SELECT count(*) AS total_conversions, count(DISTINCT user_id) AS unique_conv_users,
                       coalesce(sum(from_amount_brl) FILTER (WHERE on_), 0) AS onramp_brl,
                       coalesce(sum(to_amount_brl) FILTER (WHERE NOT on_), 0) AS offramp_brl,
                       coalesce(sum(rb), 0) AS revenue_brl, coalesce(sum(ru), 0) AS revenue_usdc,
                       coalesce(sum(vu), 0) AS volume_usd, count(*) FILTER (WHERE l30) AS conv_l30,
                       coalesce(sum(vu) FILTER (WHERE l30), 0) AS volume_usd_l30,
                       coalesce(sum(revu) FILTER (WHERE l30), 0) AS revenue_usd_l30,
                       coalesce(sum(revu), 0) AS revenue_usd FROM r2),
         x AS (SELECT * FROM dep, trf, cv)
    SELECT metric, round(value, 6) AS value FROM (
        SELECT 'PIX IN (dep)' AS metric, CAST(pix_in AS DOUBLE) AS value FROM x
        UNION ALL SELECT 'PIX OUT (transf)', CAST(pix_out AS DOUBLE) FROM x
        UNION ALL SELECT 'PIX NET', CAST(pix_in - pix_out AS DOUBLE) FROM x
        UNION ALL SELECT 'Avg ticket IN (BRL)', coalesce(avg_in, 0.0) FROM x
        UNION ALL SELECT 'Avg ticket OUT (BRL)', coalesce(avg_out, 0.0) FROM x
        UNION ALL SELECT 'Unique users IN', CAST(unique_in AS DOUBLE) FROM x
        UNION ALL SELECT 'Unique users OUT', CAST(unique_out AS DOUBLE) FROM x
        UNION ALL SELECT 'Total conversions', CAST(total_conversions AS DOUBLE) FROM x
        UNION ALL SELECT 'Unique conversion users', CAST(unique_conv_users AS DOUBLE) FROM x
        UNION ALL SELECT 'Onramp volume BRL', CAST(onramp_brl AS DOUBLE) FROM x
        UNION ALL SELECT 'Offramp volume BRL', CAST(offramp_brl AS DOUBLE) FROM x
        UNION ALL SELECT 'Total revenue BRL', CAST(revenue_brl AS DOUBLE) FROM x
        UNION ALL SELECT 'Total revenue USDC', CAST(revenue_usdc AS DOUBLE) FROM x
        UNION ALL SELECT 'Total volume USD', CAST(volume_usd AS DOUBLE) FROM x
        UNION ALL SELECT 'Total conversions L30', CAST(conv_l30 AS DOUBLE) FROM x
        UNION ALL SELECT 'Total volume USD L30', CAST(volume_usd_l30 AS DOUBLE) FROM x
        UNION ALL SELECT 'Total revenue USD L30', CAST(revenue_usd_l30 AS DOUBLE) FROM x
        UNION ALL SELECT 'Total revenue USD', CAST(revenue_usd AS DOUBLE) FROM x)""",
         ["dep_settled", "trf_completed", "conv_used"])


@query("ramp_summary", with_views("SELECT * FROM summary", "summary"))
def _summary(b: Bound):
    return ramp.ramp_summary(conversions(b), settled_deposits(b), completed_transfers(b), AS_OF)
