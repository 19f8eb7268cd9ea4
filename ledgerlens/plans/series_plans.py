"""Ordered scans and series: inventory PnL, EWMA, running and rolling metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl, rnd
from ..operators import scan
from ..sources.binding import Bound
from .oracle_views import with_views
from .ramp_plans import normalized
from .registry import query


def _r(x: str, d: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), {d}) AS DOUBLE)"


@query("position_pnl", with_views(f"""
    WITH RECURSIVE ev AS (
      SELECT row_number() OVER (ORDER BY created_at, id) AS rn, id, created_at, side,
             CASE WHEN lower(direction) IN ('usdc_to_brl', 'sell', 'offramp') THEN abs(coalesce(from_amount_usdc, 0)) ELSE 0 END AS s_in,
             CASE WHEN lower(direction) IN ('brl_to_usdc', 'buy', 'onramp') THEN abs(coalesce(to_amount_usdc, 0)) ELSE 0 END AS s_out,
             CAST(effective_rate AS DOUBLE) AS price,
             CASE WHEN lower(direction) IN ('brl_to_usdc', 'buy', 'onramp') THEN CAST(effective_rate AS DOUBLE) END AS sell_rate,
             CASE WHEN lower(direction) IN ('usdc_to_brl', 'sell', 'offramp') THEN CAST(effective_rate AS DOUBLE) END AS buy_rate
      FROM norm_used WHERE created_at IS NOT NULL),
    st AS (
      SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS DECIMAL(38,6)) AS q, CAST(NULL AS DOUBLE) AS avg,
             CAST(NULL AS DOUBLE) AS before, CAST(0 AS DECIMAL(38,8)) AS pnl, CAST(0 AS DECIMAL(38,8)) AS cum
      UNION ALL
      SELECT e.rn, s.q + e.s_in - e.s_out,
             CASE WHEN e.s_in > 0 THEN
                  CASE WHEN s.q + e.s_in > 0
                       THEN (CAST(s.q AS DOUBLE) * coalesce(s.avg, 0.0) + CAST(e.s_in AS DOUBLE) * e.price) / CAST(s.q + e.s_in AS DOUBLE)
                       ELSE e.price END
                  ELSE s.avg END,
             s.avg,
             CASE WHEN e.s_out > 0 AND s.avg IS NOT NULL THEN CAST((e.sell_rate - s.avg) * CAST(e.s_out AS DOUBLE) AS DECIMAL(38,8)) ELSE 0 END,
             s.cum + CASE WHEN e.s_out > 0 AND s.avg IS NOT NULL THEN CAST((e.sell_rate - s.avg) * CAST(e.s_out AS DOUBLE) AS DECIMAL(38,8)) ELSE 0 END
      FROM st s JOIN ev e ON e.rn = s.rn + 1)
    SELECT e.created_at, e.id, e.side, CAST(e.s_in AS DOUBLE) AS stock_in_usdc, CAST(e.s_out AS DOUBLE) AS stock_out_usdc,
           CAST(s.q AS DOUBLE) AS position_qty_usdc, {_r('s.avg', 6)} AS avg_price_brl_per_usdc,
           e.sell_rate AS sell_onramp_rate, e.buy_rate AS buy_offramp_rate,
           {_r('s.pnl', 2)} AS pnl_brl, {_r('s.cum', 2)} AS pnl_cum_brl,
           CASE WHEN e.s_out > 0 AND s.before IS NOT NULL THEN {_r('(e.sell_rate - s.before) / s.before', 6)} END AS margin_sell_pct,
           CASE WHEN e.s_in > 0 AND s.before IS NOT NULL THEN {_r('(s.before - e.buy_rate) / s.before', 6)} END AS margin_buy_pct
    FROM st s JOIN ev e ON e.rn = s.rn""", "norm_used"))
def _position(b: Bound):
    p = scan.position_pnl(normalized(b))
    return p.select("created_at", "id", "side", dbl("stock_in_usdc").alias("stock_in_usdc"),
                    dbl("stock_out_usdc").alias("stock_out_usdc"), dbl("position_qty_usdc").alias("position_qty_usdc"),
                    rnd("avg_price_brl_per_usdc", 6).alias("avg_price_brl_per_usdc"), "sell_onramp_rate",
                    "buy_offramp_rate", rnd("pnl_brl", 2).alias("pnl_brl"), rnd("pnl_cum_brl", 2).alias("pnl_cum_brl"),
                    rnd("margin_sell_pct", 6).alias("margin_sell_pct"), rnd("margin_buy_pct", 6).alias("margin_buy_pct"))


# ------------------------------------------------------------------ EWMA
from ..operators import pricing as pr  # noqa: E402
from ..operators import revenue as rv  # noqa: E402
from ..operators import series as se  # noqa: E402
from ..operators import users as us  # noqa: E402
from ..sources.binding import FULL_END, FULL_START  # noqa: E402
from .oracle_views import register  # noqa: E402
from .ramp_plans import card_spend, conversions  # noqa: E402
from .user_plans import WIN, master, month_streams  # noqa: E402


def daily(b: Bound):
    return pr.build_daily(card_spend(b))


def _ewm_sql(value: str) -> str:
    return f"""
    SELECT "date", v, ewm, v - ewm AS residual,
           coalesce(stddev_samp(v - ewm) OVER (ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0) AS rolling_std
    FROM (SELECT a."date", a.v, sum(b.v * pow(0.75, a.rn - b.rn)) / sum(pow(0.75, a.rn - b.rn)) AS ewm
          FROM (SELECT row_number() OVER (ORDER BY "date") AS rn, "date", CAST({value} AS DOUBLE) AS v FROM daily_cards) a
          JOIN (SELECT row_number() OVER (ORDER BY "date") AS rn, CAST({value} AS DOUBLE) AS v FROM daily_cards) b
            ON b.rn <= a.rn
          GROUP BY a."date", a.v, a.rn)"""


register("ewm_count", _ewm_sql("daily_count"), ["daily_cards"])
register("ewm_vol", _ewm_sql("daily_volume_usd"), ["daily_cards"])


def _fc_sql(src: str) -> str:
    return f"""
    WITH f AS (SELECT *, row_number() OVER (ORDER BY "date" DESC) AS rn FROM {src}),
         st AS (SELECT arg_max(ewm, "date") AS lvl, arg_max(rolling_std, "date") AS rstd, stddev_samp(residual) AS sd,
                       max("date") AS last, avg(CASE WHEN rn <= 30 THEN v END) AS lr, avg(v) AS mean FROM f),
         dw AS (SELECT isodow("date") - 1 AS dow, avg(v) AS dm FROM f GROUP BY 1),
         h AS (SELECT CAST(range AS BIGINT) AS h FROM range(1, 6)),
         s AS (SELECT h.h, CAST(st.last + CAST(h.h AS INTEGER) AS DATE) AS "date", st.*,
                      greatest((st.lr + pow(0.75, h.h) * (st.lvl - st.lr))
                               * CASE WHEN st.mean > 0 THEN coalesce(dw.dm / st.mean, 1.0) ELSE 1.0 END, 0.0) AS pt,
                      1.96 * greatest(st.rstd, coalesce(st.sd, 0.0)) * sqrt(CAST(h.h AS DOUBLE)) AS margin
               FROM h CROSS JOIN st LEFT JOIN dw ON dw.dow = isodow(CAST(st.last + CAST(h.h AS INTEGER) AS DATE)) - 1)
    SELECT h, "date", pt AS forecast, greatest(pt - margin, 0.0) AS ci_lower, pt + margin AS ci_upper FROM s"""


register("fc_count", _fc_sql("ewm_count"), ["ewm_count"])
register("fc_vol", _fc_sql("ewm_vol"), ["ewm_vol"])


@query("ewma_fit", with_views(f"""
    SELECT "date", v AS daily_count, {_r('ewm', 6)} AS ewm, {_r('residual', 6)} AS residual,
           {_r('rolling_std', 6)} AS rolling_std FROM ewm_count""", "ewm_count"))
def _ewma_fit(b: Bound):
    f = se.ewma_fit(daily(b), "daily_count")
    return f.select("date", dbl("daily_count").alias("daily_count"), rnd("ewm", 6).alias("ewm"),
                    rnd("residual", 6).alias("residual"), rnd("rolling_std", 6).alias("rolling_std"))


def _fc_out(df):
    return df.select("h", "date", rnd("forecast", 4).alias("forecast"), rnd("ci_lower", 4).alias("ci_lower"),
                     rnd("ci_upper", 4).alias("ci_upper"))


@query("ewma_forecast", with_views(f"""
    SELECT h, "date", {_r('forecast', 4)} AS forecast, {_r('ci_lower', 4)} AS ci_lower, {_r('ci_upper', 4)} AS ci_upper
    FROM fc_count""", "fc_count"))
def _ewma_fc(b: Bound):
    return _fc_out(se.ewma_forecast(daily(b), "daily_count"))


@query("ewma_forecast_volume", with_views(f"""
    SELECT h, "date", {_r('forecast', 4)} AS forecast, {_r('ci_lower', 4)} AS ci_lower, {_r('ci_upper', 4)} AS ci_upper
    FROM fc_vol""", "fc_vol"))
def _ewma_fc_vol(b: Bound):
    return _fc_out(se.ewma_forecast(daily(b), "daily_volume_usd"))


@query("usage_summary", with_views(f"""
    WITH t AS (SELECT max("date") AS today FROM daily_cards),
         w AS (SELECT label, n FROM (VALUES ('last_7d', 7), ('last_30d', 30), ('all', NULL)) v(label, n)),
         a AS (SELECT w.label AS period, CAST(sum(d.daily_count) AS DOUBLE) AS tx_count,
                      CAST(sum(CAST(d.daily_volume_usd AS DECIMAL(30,10))) AS DOUBLE) AS volume_usd,
                      {_r('CAST(sum(d.daily_count) AS DOUBLE) / count(d.daily_count)', 1)} AS avg_count_day,
                      {_r('CAST(sum(CAST(d.daily_volume_usd AS DECIMAL(30,10))) AS DOUBLE) / count(d.daily_volume_usd)', 2)} AS avg_vol_day
               FROM w CROSS JOIN t JOIN daily_cards d ON w.n IS NULL OR d."date" >= t.today - CAST(w.n - 1 AS INTEGER)
               GROUP BY w.label),
         f AS (SELECT 'next_5d_forecast' AS period,
                      {_r('sum(CAST(c.forecast AS DECIMAL(30,10)))', 1)} AS tx_count,
                      {_r('sum(CAST(v.forecast AS DECIMAL(30,10)))', 6)} AS volume_usd,
                      {_r('CAST(sum(CAST(c.forecast AS DECIMAL(30,10))) AS DOUBLE) / count(*)', 1)} AS avg_count_day,
                      {_r('CAST(sum(CAST(v.forecast AS DECIMAL(30,10))) AS DOUBLE) / count(*)', 2)} AS avg_vol_day
               FROM fc_count c JOIN fc_vol v ON v.h = c.h)
    SELECT * FROM a UNION ALL SELECT * FROM f""", "daily_cards", "fc_count", "fc_vol"))
def _usage(b: Bound):
    d = daily(b)
    return se.usage_summary(d, se.ewma_forecast(d, "daily_count"), se.ewma_forecast(d, "daily_volume_usd"))


# ------------------------------------------------------- monthly series
register("vol_monthly", f"""
    SELECT CAST(date_trunc('month', "date") AS DATE) AS month,
           CAST(sum(CAST(CAST(onramp AS VARCHAR) AS DECIMAL(30,10))) AS DOUBLE) AS onramp, CAST(sum(CAST(CAST(offramp AS VARCHAR) AS DECIMAL(30,10))) AS DOUBLE) AS offramp,
           CAST(sum(CAST(CAST(onramp AS VARCHAR) AS DECIMAL(30,10))) + sum(CAST(CAST(offramp AS VARCHAR) AS DECIMAL(30,10))) AS DOUBLE) AS total
    FROM conv_daily GROUP BY 1""", ["conv_daily"])


def vol_monthly(b: Bound):
    from ..operators import ramp
    from .ramp_plans import normalized as nm
    return rv.volume_monthly_total(ramp.conv_daily_pivot(nm(b)))


@query("volume_monthly_total", with_views("SELECT * FROM vol_monthly", "vol_monthly"))
def _vol_monthly(b: Bound):
    return vol_monthly(b)


@query("mom_change", with_views("""
    SELECT month, total, CASE WHEN lag(total) OVER (ORDER BY month) <> 0
        THEN round((total - lag(total) OVER (ORDER BY month)) / abs(lag(total) OVER (ORDER BY month)) * 100, 6) END AS mom_change_pct
    FROM vol_monthly""", "vol_monthly"))
def _mom(b: Bound):
    return se.mom_change(vol_monthly(b).select("month", "total"), "total", "month")


@query("rolling_7d_mean", with_views(f"""
    SELECT "date", {_r('CAST(sum(CAST(daily_count AS DECIMAL(30,10))) OVER w AS DOUBLE) / CAST(count(daily_count) OVER w AS DOUBLE)', 1)} AS daily_count_rolling_7,
           {_r('CAST(sum(CAST(daily_volume_usd AS DECIMAL(30,10))) OVER w AS DOUBLE) / CAST(count(daily_volume_usd) OVER w AS DOUBLE)', 2)} AS daily_volume_usd_rolling_7
    FROM daily_cards WINDOW w AS (ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", "daily_cards"))
def _rolling(b: Bound):
    return se.rolling_mean(daily(b), {"daily_count": 1, "daily_volume_usd": 2})


@query("last_value_kpi", with_views(
    "SELECT arg_max(total, month) AS last_value, max(month) AS as_of FROM vol_monthly WHERE total IS NOT NULL",
    "vol_monthly"))
def _last_value(b: Bound):
    return se.last_value_kpi(vol_monthly(b), "total", "month")


@query("window_avg", with_views(
    "SELECT round(CAST(sum(CAST(total AS DECIMAL(30,10))) AS DOUBLE) / count(total), 6) AS avg_last_3 "
    "FROM (SELECT total FROM vol_monthly ORDER BY month DESC LIMIT 3)", "vol_monthly"))
def _window_avg(b: Bound):
    return se.window_avg(vol_monthly(b), "total", "month", 3)


# ------------------------------------------------------------ user ranks
register("lorenz", """
    WITH p AS (SELECT user_id, CAST(net_revenue_usd AS DOUBLE) AS v FROM master WHERE net_revenue_usd > 0),
         r AS (SELECT user_id, v, row_number() OVER (ORDER BY v DESC, user_id) AS rank,
                      sum(CAST(round(v * 1000000) AS BIGINT)) OVER (ORDER BY v DESC, user_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cu FROM p),
         t AS (SELECT count(*) AS n, sum(CAST(round(v * 1000000) AS BIGINT)) AS tot FROM p)
    SELECT user_id, v AS net_revenue_usd, CAST(rank AS BIGINT) AS rank, round(CAST(rank AS DOUBLE) * 100 / n, 6) AS cum_users_pct,
           round(CAST(cu AS DOUBLE) * 100 / CAST(tot AS DOUBLE), 6) AS cum_revenue_pct
    FROM r CROSS JOIN t""", ["master"])


@query("lorenz_curve", with_views("SELECT * FROM lorenz", "lorenz"))
def _lorenz(b: Bound):
    return se.lorenz_curve(master(b))


@query("top_decile_share", with_views("""
    SELECT greatest(1, n // 10) AS top_n_users, n AS n_positive_users,
           coalesce((SELECT cum_revenue_pct FROM lorenz WHERE rank = greatest(1, n // 10)), 0.0) AS top_decile_share_pct
    FROM (SELECT count(*) AS n FROM lorenz)""", "lorenz"))
def _top_decile(b: Bound):
    return se.top_decile_share(master(b))


# ------------------------------------------------------ product revenue
_USD = "CAST(CAST(({x}) / NULLIF(exchange_rate, 0) AS VARCHAR) AS DECIMAL(30,10))"


@query("daily_revenue_by_product", with_views(f"""
    WITH c AS (SELECT CAST(created_at AS DATE) AS d,
                      sum(CAST(coalesce({_USD.format(x='coalesce(fee_amount_brl, 0)')}, 0) + coalesce(fee_amount_usdc, 0)
                          + coalesce({_USD.format(x='coalesce(spread_revenue_brl, 0)')}, 0) + coalesce(spread_revenue_usdc, 0) AS DECIMAL(28,10))) AS v
               FROM conv_used GROUP BY 1),
         f AS (SELECT CAST(created_at AS DATE) AS d, sum(amount_usdc) AS v FROM card_annual_fees
               WHERE status = 'paid' AND {WIN.format(c='created_at')} GROUP BY 1),
         bl AS (SELECT CAST(created_at AS DATE) AS d, sum(CAST(amount AS DECIMAL(20,0)) * 0.000001) AS v FROM billing_charges
                WHERE status = 'settled' AND {WIN.format(c='created_at')} GROUP BY 1),
         sw AS (SELECT CAST("timestamp" AS DATE) AS d,
                       sum(CASE WHEN input_mint = 'USDC' THEN CAST(input_amount AS DECIMAL(20,0)) * CAST(platform_fee_bps AS DECIMAL(5,0)) * 0.0000000001
                                WHEN output_mint = 'USDC' THEN CAST(output_amount AS DECIMAL(20,0)) * CAST(platform_fee_bps AS DECIMAL(5,0)) * 0.0000000001
                                ELSE 0 END) AS v FROM swap_transactions WHERE {WIN.format(c='"timestamp"')} GROUP BY 1),
         days AS (SELECT d FROM c UNION SELECT d FROM f UNION SELECT d FROM bl UNION SELECT d FROM sw),
         sp AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM days), (SELECT max(d) FROM days), INTERVAL 1 DAY)) AS DATE) AS d)
    SELECT sp.d AS "date", CAST(coalesce(c.v, 0) AS DOUBLE) AS daily_rev_conversion_usd,
           CAST(coalesce(f.v, 0) AS DOUBLE) AS daily_rev_card_fees_usd, CAST(coalesce(bl.v, 0) AS DOUBLE) AS daily_rev_billing_usd,
           CAST(coalesce(sw.v, 0) AS DOUBLE) AS daily_rev_swap_usd,
           CAST(coalesce(c.v, 0) + coalesce(f.v, 0) + coalesce(bl.v, 0) + coalesce(sw.v, 0) AS DOUBLE) AS daily_rev_usd
    FROM sp LEFT JOIN c ON c.d = sp.d LEFT JOIN f ON f.d = sp.d LEFT JOIN bl ON bl.d = sp.d LEFT JOIN sw ON sw.d = sp.d""",
                                              "conv_used", "card_annual_fees", "billing_charges", "swap_transactions"))
def _daily_product(b: Bound):
    return rv.daily_revenue_by_product(conversions(b), b.card_ledger, FULL_START, FULL_END)


_W2 = "{c} >= TIMESTAMP '1997-01-01' AND {c} < TIMESTAMP '2000-01-01'"


@query("revenue_totals_by_window", with_views(f"""
    SELECT CAST(coalesce((SELECT sum(amount_usdc) FROM card_annual_fees WHERE status = 'paid' AND {_W2.format(c='created_at')}), 0) AS DOUBLE) AS annual_fees_usd,
           CAST(coalesce((SELECT sum(CAST(amount AS DECIMAL(20,0)) * 0.000001) FROM billing_charges
                          WHERE status = 'settled' AND {_W2.format(c='created_at')}), 0) AS DOUBLE) AS billing_usd""",
                                              "card_annual_fees", "billing_charges"))
def _rev_window(b: Bound):
    return rv.revenue_totals_by_window(b.card_annual_fees, b.billing_charges, "1997-01-01", "1999-12-31")


register("card_terms", f"""
    SELECT COALESCE(f.month, bl.month) AS month, f.v AS annual_fee_usd, bl.v AS billing_usd FROM
      (SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, sum(amount_usdc) AS v FROM card_annual_fees
       WHERE status = 'paid' AND {WIN.format(c='created_at')} GROUP BY 1) f
    FULL OUTER JOIN
      (SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, sum(CAST(amount AS DECIMAL(20,0)) * 0.000001) AS v
       FROM billing_charges WHERE status = 'settled' AND {WIN.format(c='created_at')} GROUP BY 1) bl ON f.month = bl.month""",
         ["card_annual_fees", "billing_charges"])


@query("monthly_card_revenue_terms", with_views("""
    SELECT month, 'annual_fee_usd' AS term, CAST(annual_fee_usd AS DOUBLE) AS value FROM card_terms WHERE annual_fee_usd IS NOT NULL
    UNION ALL SELECT month, 'billing_usd', CAST(billing_usd AS DOUBLE) FROM card_terms WHERE billing_usd IS NOT NULL""",
                                                "card_terms"))
def _card_terms(b: Bound):
    f, bl = rv.monthly_card_revenue_terms(b.card_annual_fees, b.billing_charges, FULL_START, FULL_END)
    return f.select("month", F.lit("annual_fee_usd").alias("term"), dbl("annual_fee_usd").alias("value")).unionByName(
        bl.select("month", F.lit("billing_usd").alias("term"), dbl("billing_usd").alias("value")))


@query("card_revenue_monthly", with_views("""
    SELECT month, CAST(coalesce(annual_fee_usd, 0) AS DOUBLE) AS annual_fee_usd, CAST(coalesce(billing_usd, 0) AS DOUBLE) AS billing_usd,
           CAST(coalesce(annual_fee_usd, 0) + coalesce(billing_usd, 0) AS DOUBLE) AS card_revenue_usd FROM card_terms""",
                                          "card_terms"))
def _card_rev_monthly(b: Bound):
    f, bl = rv.monthly_card_revenue_terms(b.card_annual_fees, b.billing_charges, FULL_START, FULL_END)
    return rv.card_revenue_monthly(f, bl)


@query("merge_monthly_streams", with_views("""
    SELECT c.user_id, c.month, CAST(c.brl AS DOUBLE) AS conversion_revenue_brl, CAST(c.usdc AS DOUBLE) AS conversion_revenue_usdc,
           CAST(coalesce(cf.card_fee_usd, 0) AS DOUBLE) AS card_fee_usd, CAST(coalesce(bl.billing_usd, 0) AS DOUBLE) AS billing_usd,
           CAST(coalesce(cb.cashback_usd, 0) AS DOUBLE) AS cashback_usd,
           CAST(coalesce(rs.revenue_share_usd, 0) AS DOUBLE) AS revenue_share_usd
    FROM lt_conv c LEFT JOIN lt_cf cf ON cf.user_id = c.user_id AND cf.month = c.month
    LEFT JOIN lt_bl bl ON bl.user_id = c.user_id AND bl.month = c.month
    LEFT JOIN lt_cb cb ON cb.user_id = c.user_id AND cb.month = c.month
    LEFT JOIN lt_rs rs ON rs.user_id = c.user_id AND rs.month = c.month""", "lt_conv", "lt_cf", "lt_bl", "lt_cb", "lt_rs"))
def _merge_monthly(b: Bound):
    base = us.conversion_monthly(conversions(b))
    m = rv.merge_monthly_streams(base, month_streams(b, ("card_fee_usd", "billing_usd", "cashback_usd",
                                                         "revenue_share_usd")))
    return m.select("user_id", "month", *[dbl(c).alias(c) for c in m.columns if c not in ("user_id", "month")])


@query("self_first_value_join", with_views("""
    SELECT user_id, month, min(month) OVER (PARTITION BY user_id) AS first_month FROM lt_conv""", "lt_conv"))
def _first_value(b: Bound):
    base = us.conversion_monthly(conversions(b)).select("user_id", "month")
    return rv.self_first_value_join(base, "user_id", "month", "first_month")


@query("calendar_spine_join", with_views("""
    SELECT sp.d AS signup_date, CAST(coalesce(s.new_signups, 0) AS BIGINT) AS new_signups
    FROM (SELECT CAST(unnest(generate_series((SELECT min(signup_date) FROM signups_daily),
                                             (SELECT max(signup_date) FROM signups_daily), INTERVAL 1 DAY)) AS DATE) AS d) sp
    LEFT JOIN signups_daily s ON s.signup_date = sp.d""", "signups_daily"))
def _spine_join(b: Bound):
    from ..functions.calendar import spine_from
    from .campaign_plans import signups_daily
    daily = signups_daily(b)
    return rv.calendar_spine_join(daily, spine_from(daily, "signup_date"),
                                  "signup_date", ["new_signups"]).withColumn("new_signups",
                                                                             F.col("new_signups").cast("bigint"))


@query("top_spenders_enriched", with_views(f"""
    WITH agg AS (SELECT user_id, count(*) AS n_transactions, sum(CAST(amount_usd_cents AS DECIMAL(20,0)) * 0.01) AS total
                 FROM card_transactions WHERE status = 'completed' AND transaction_type = 'spend' AND posted_at IS NOT NULL
                   AND {WIN.format(c='posted_at')}
                 GROUP BY 1 ORDER BY total DESC, user_id LIMIT 20),
         cq AS (SELECT user_id, count(*) AS ramp_conversions FROM conversion_quotes WHERE used = TRUE GROUP BY 1)
    SELECT a.user_id, u.full_name,
           coalesce(ur.source_type, CASE WHEN f.invite_code IS NOT NULL AND f.invite_code <> '' THEN 'founder_invite' ELSE 'unknown' END) AS acquisition_source,
           rc.code AS referral_code, rc.public_name AS referral_code_name, a.n_transactions, CAST(a.total AS DOUBLE) AS total_usd,
           CAST(coalesce(cq.ramp_conversions, 0) AS BIGINT) AS ramp_conversions
    FROM agg a LEFT JOIN app_users u ON u.user_id = a.user_id LEFT JOIN user_registrations ur ON ur.user_id = a.user_id
    LEFT JOIN referral_codes rc ON rc.id = ur.attributed_referral_code_id LEFT JOIN founders f ON f.user_id = a.user_id
    LEFT JOIN cq ON cq.user_id = a.user_id""", "card_transactions", "conversion_quotes", "app_users",
                                           "user_registrations", "referral_codes", "founders"))
def _top_spenders(b: Bound):
    return rv.top_spenders_enriched(b.card_transactions, b.app_users, b.user_registrations, b.founders,
                                    b.referral_codes, b.conversion_quotes, 20, FULL_START, FULL_END)


_GRID = [(f, p) for f in (0.0, 0.25, 0.5) for p in (0.0, 0.01, 0.02)]


@query("param_grid_cross_join", with_views("""
    SELECT g.flat_fee, g.pct_fee,
           CAST(round(CAST(CAST(CAST(g.flat_fee AS DECIMAL(10,4)) * n + CAST(g.pct_fee AS DECIMAL(10,4)) * coalesce(s, 0) AS DOUBLE)
                           / CAST(n_days AS DOUBLE) * 30 AS DECIMAL(30,10)), 2) AS DOUBLE) AS monthly_revenue_usd
    FROM (SELECT * FROM (VALUES """ + ", ".join(f"(CAST({f!r} AS DOUBLE), CAST({p!r} AS DOUBLE))" for f, p in _GRID)
                                           + """) v(flat_fee, pct_fee)) g CROSS JOIN ndays""", "ndays"))
def _param_grid(b: Bound):
    agg = pr._totals(card_spend(b))
    grid = pr.const_table(agg, ("flat_fee", "pct_fee"), _GRID)
    rev = (F.col("flat_fee").cast("decimal(10,4)") * F.col("n") + F.col("pct_fee").cast("decimal(10,4)")
           * F.coalesce(F.col("s"), F.lit(0)))
    return rv.param_grid_cross_join(agg, grid, rnd(dbl(rev) / dbl("n_days") * 30, 2), "monthly_revenue_usd")


# ---------------------------------------------------------- keyed EWMA
register("acct_monthly", """
    SELECT account_id, CAST(period || '-01' AS DATE) AS "date", CAST(n_transactions AS DOUBLE) AS v FROM card_invoices""",
         ["card_invoices"])


@query("ewma_fit_by_account", with_views(f"""
    WITH d AS (SELECT account_id, "date", v, row_number() OVER (PARTITION BY account_id ORDER BY "date") AS rn
               FROM acct_monthly),
         e AS (SELECT a.account_id, a."date", a.v,
                      sum(b.v * pow(0.75, a.rn - b.rn)) / sum(pow(0.75, a.rn - b.rn)) AS ewm
               FROM d a JOIN d b ON b.account_id = a.account_id AND b.rn <= a.rn
               GROUP BY a.account_id, a."date", a.v, a.rn)
    SELECT account_id, "date", v AS n_transactions, {_r('ewm', 6)} AS ewm, {_r('v - ewm', 6)} AS residual,
           {_r('coalesce(stddev_samp(v - ewm) OVER (PARTITION BY account_id ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0)', 6)} AS rolling_std
    FROM e""", "acct_monthly"))
def _ewma_by_account(b: Bound):
    m = b.card_invoices.select("account_id", F.to_date(F.concat("period", F.lit("-01"))).alias("date"),
                               dbl("n_transactions").alias("n_transactions"))
    f = se.ewma_fit(m, "n_transactions", keys=("account_id",))
    return f.select("account_id", "date", "n_transactions", rnd("ewm", 6).alias("ewm"),
                    rnd("residual", 6).alias("residual"), rnd("rolling_std", 6).alias("rolling_std"))
