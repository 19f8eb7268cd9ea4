"""Cohort LTV / retention and segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl
from ..operators import cohorts, segments, users
from ..session import written_table
from ..sources.binding import FULL_END, FULL_START, Bound
from .oracle_views import register, with_views
from .ramp_plans import conversions
from .registry import query
from .user_plans import WIN, cohort_base, daily_activity, fx_rate, master, month_streams


def ltv(b: Bound, months: str = "conversions"):
    """Long (user, month since signup) table (lazy; see ``master``)."""
    conv_m = users.conversion_monthly(conversions(b))
    zero = F.lit(0).cast("decimal(28,10)")  # swaps are off in the cohort tables
    wide = month_streams(b).withColumnRenamed("n_card_spend", "n_card_txns").withColumn("swap_fee_usd", zero)
    total = users.ledger_rows(b.card_ledger, ["n_card_spend"], FULL_START, FULL_END).agg(
        F.count(F.lit(1)).alias("n_card_txns"))
    return cohorts.user_monthly_ltv(conv_m, wide, None, cohort_base(b), fx_rate(b), months=months, card_total=total)


def _dec_stream(name: str, table: str, expr: str, ts: str, pred: str, user: str = "user_id") -> str:
    return f"""SELECT {user} AS user_id, CAST(date_trunc('month', {ts}) AS DATE) AS month,
               CAST(sum({expr}) AS DECIMAL(28,10)) AS {name}
               FROM {table} WHERE {pred} {'AND' if pred else ''} {WIN.format(c=ts)} GROUP BY 1, 2"""


register("lt_conv", """
    SELECT user_id, CAST(date_trunc('month', created_at) AS DATE) AS month,
           CAST(sum(coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0)) AS DECIMAL(28,10)) AS brl,
           CAST(sum(coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0)) AS DECIMAL(28,10)) AS usdc
    FROM conv_used GROUP BY 1, 2""", ["conv_used"])
register("lt_cf", _dec_stream("card_fee_usd", "card_annual_fees", "amount_usdc", "created_at", "status = 'paid'"),
         ["card_annual_fees"])
register("lt_bl", _dec_stream("billing_usd", "billing_charges", "CAST(amount AS DECIMAL(20,0)) * 0.000001",
                              "created_at", "status = 'settled'"), ["billing_charges"])
register("lt_cb", _dec_stream("cashback_usd", "cashback_rewards", "reward_usd_value", "created_at",
                              "status = 'completed'"), ["cashback_rewards"])
register("lt_rs", _dec_stream("revenue_share_usd", "revenue_share_rewards", "reward_usd_value", "created_at",
                              "status = 'completed'", "source_user_id"), ["revenue_share_rewards"])
register("lt_cc", f"""
    SELECT user_id, CAST(date_trunc('month', posted_at) AS DATE) AS month, count(*) AS n_card_txns
    FROM card_transactions WHERE status = 'completed' AND transaction_type = 'spend' AND posted_at IS NOT NULL
      AND {WIN.format(c='posted_at')} GROUP BY 1, 2""", ["card_transactions"])
register("ltv", """
    WITH cpt AS (SELECT 6693.58 / greatest(coalesce(CAST(sum(n_card_txns) AS DOUBLE), 0.0), 1.0) AS c FROM lt_cc),
    m AS (
      SELECT c.user_id, c.month,
             CAST(CAST(CAST(c.brl AS DOUBLE) / fx.fx_rate AS DECIMAL(30,10)) + coalesce(c.usdc, 0) AS DECIMAL(28,10)) AS conv_usd,
             CAST(coalesce(cf.card_fee_usd, 0) AS DECIMAL(28,10)) AS card_fee_usd,
             CAST(coalesce(bl.billing_usd, 0) AS DECIMAL(28,10)) AS billing_usd,
             CAST(0 AS DECIMAL(28,10)) AS swap_fee_usd,
             CAST(coalesce(cb.cashback_usd, 0) AS DECIMAL(28,10)) AS cashback_usd,
             CAST(coalesce(rs.revenue_share_usd, 0) AS DECIMAL(28,10)) AS revenue_share_usd,
             CAST(coalesce(CAST(CAST(cc.n_card_txns AS DOUBLE) * cpt.c AS DECIMAL(30,10)), 0) AS DECIMAL(28,10)) AS card_cost_usd
      FROM lt_conv c CROSS JOIN fx CROSS JOIN cpt
      LEFT JOIN lt_cf cf ON cf.user_id = c.user_id AND cf.month = c.month
      LEFT JOIN lt_bl bl ON bl.user_id = c.user_id AND bl.month = c.month
      LEFT JOIN lt_cb cb ON cb.user_id = c.user_id AND cb.month = c.month
      LEFT JOIN lt_rs rs ON rs.user_id = c.user_id AND rs.month = c.month
      LEFT JOIN lt_cc cc ON cc.user_id = c.user_id AND cc.month = c.month),
    g AS (SELECT *, conv_usd + card_fee_usd + billing_usd + swap_fee_usd AS gross_revenue_usd FROM m),
    n AS (SELECT *, gross_revenue_usd - cashback_usd - revenue_share_usd - card_cost_usd AS net FROM g),
    j AS (SELECT n.*, CAST(date_trunc('month', b.signup_date) AS DATE) AS signup_month, b.acquisition_source,
                 CAST((year(n.month) * 12 + month(n.month))
                      - (year(b.signup_date) * 12 + month(b.signup_date)) AS BIGINT) AS months_since_signup
          FROM n JOIN cohort_base b ON b.user_id = n.user_id),
    k AS (SELECT *, months_since_signup = min(months_since_signup) OVER (PARTITION BY user_id) AS kyc_deducted
          FROM j WHERE months_since_signup >= 0),
    r AS (SELECT *, CASE WHEN kyc_deducted THEN CAST(net - CAST(2.07 AS DECIMAL(10,2)) AS DECIMAL(28,10))
                         ELSE CAST(net AS DECIMAL(28,10)) END AS revenue_usd FROM k)
    SELECT user_id, signup_month, acquisition_source, months_since_signup, kyc_deducted, revenue_usd,
           CAST(gross_revenue_usd AS DECIMAL(28,10)) AS gross_revenue_usd, card_fee_usd, billing_usd, swap_fee_usd,
           CAST(sum(revenue_usd) OVER (PARTITION BY user_id ORDER BY months_since_signup
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(28,10)) AS cum_ltv,
           CAST(sum(gross_revenue_usd) OVER (PARTITION BY user_id ORDER BY months_since_signup
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(28,10)) AS cum_gross_ltv
    FROM r""", ["lt_conv", "lt_cf", "lt_bl", "lt_cb", "lt_rs", "lt_cc", "fx", "cohort_base"])
register("lt_keys", f"""
    SELECT user_id, month FROM lt_conv UNION SELECT user_id, month FROM lt_cf UNION SELECT user_id, month FROM lt_bl
    UNION SELECT user_id, month FROM lt_cb UNION SELECT user_id, month FROM lt_rs UNION SELECT user_id, month FROM lt_cc
    UNION SELECT user_id, CAST(date_trunc('month', "timestamp") AS DATE) FROM swap_transactions WHERE {WIN.format(c='"timestamp"')}""",
         ["lt_conv", "lt_cf", "lt_bl", "lt_cb", "lt_rs", "lt_cc", "swap_transactions"])
register("ltv_all", """
    WITH cpt AS (SELECT 6693.58 / greatest(coalesce(CAST(sum(n_card_txns) AS DOUBLE), 0.0), 1.0) AS c FROM lt_cc),
    m AS (
      SELECT c.user_id, c.month,
             CAST(coalesce(CAST(CAST(c.brl AS DOUBLE) / fx.fx_rate AS DECIMAL(30,10)), 0) + coalesce(c.usdc, 0) AS DECIMAL(28,10)) AS conv_usd,
             CAST(coalesce(cf.card_fee_usd, 0) AS DECIMAL(28,10)) AS card_fee_usd,
             CAST(coalesce(bl.billing_usd, 0) AS DECIMAL(28,10)) AS billing_usd,
             CAST(0 AS DECIMAL(28,10)) AS swap_fee_usd,
             CAST(coalesce(cb.cashback_usd, 0) AS DECIMAL(28,10)) AS cashback_usd,
             CAST(coalesce(rs.revenue_share_usd, 0) AS DECIMAL(28,10)) AS revenue_share_usd,
             CAST(coalesce(CAST(CAST(cc.n_card_txns AS DOUBLE) * cpt.c AS DECIMAL(30,10)), 0) AS DECIMAL(28,10)) AS card_cost_usd
      FROM (SELECT k.user_id, k.month, lc.brl, lc.usdc FROM lt_keys k LEFT JOIN lt_conv lc
            ON lc.user_id = k.user_id AND lc.month = k.month) c CROSS JOIN fx CROSS JOIN cpt
      LEFT JOIN lt_cf cf ON cf.user_id = c.user_id AND cf.month = c.month
      LEFT JOIN lt_bl bl ON bl.user_id = c.user_id AND bl.month = c.month
      LEFT JOIN lt_cb cb ON cb.user_id = c.user_id AND cb.month = c.month
      LEFT JOIN lt_rs rs ON rs.user_id = c.user_id AND rs.month = c.month
      LEFT JOIN lt_cc cc ON cc.user_id = c.user_id AND cc.month = c.month),
    g AS (SELECT *, conv_usd + card_fee_usd + billing_usd + swap_fee_usd AS gross_revenue_usd FROM m),
    n AS (SELECT *, gross_revenue_usd - cashback_usd - revenue_share_usd - card_cost_usd AS net FROM g),
    j AS (SELECT n.*, CAST(date_trunc('month', b.signup_date) AS DATE) AS signup_month, b.acquisition_source,
                 CAST((year(n.month) * 12 + month(n.month))
                      - (year(b.signup_date) * 12 + month(b.signup_date)) AS BIGINT) AS months_since_signup
          FROM n JOIN cohort_base b ON b.user_id = n.user_id),
    k AS (SELECT *, months_since_signup = min(months_since_signup) OVER (PARTITION BY user_id) AS kyc_deducted
          FROM j WHERE months_since_signup >= 0),
    r AS (SELECT *, CASE WHEN kyc_deducted THEN CAST(net - CAST(2.07 AS DECIMAL(10,2)) AS DECIMAL(28,10))
                         ELSE CAST(net AS DECIMAL(28,10)) END AS revenue_usd FROM k)
    SELECT user_id, signup_month, acquisition_source, months_since_signup, kyc_deducted, revenue_usd,
           CAST(gross_revenue_usd AS DECIMAL(28,10)) AS gross_revenue_usd, card_fee_usd, billing_usd, swap_fee_usd,
           CAST(sum(revenue_usd) OVER (PARTITION BY user_id ORDER BY months_since_signup
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(28,10)) AS cum_ltv,
           CAST(sum(gross_revenue_usd) OVER (PARTITION BY user_id ORDER BY months_since_signup
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(28,10)) AS cum_gross_ltv
    FROM r""", ["lt_keys", "lt_conv", "lt_cf", "lt_bl", "lt_cb", "lt_rs", "lt_cc", "fx", "cohort_base"])
register("ltv_active", "SELECT signup_month, count(DISTINCT user_id) AS n_active_users FROM ltv GROUP BY 1",
         ["ltv"])


def _lq(body: str, *extra: str) -> str:
    return with_views(body, "ltv", *extra)


@query("user_monthly_ltv", _lq("""
    SELECT user_id, signup_month, acquisition_source, months_since_signup,
           CAST(revenue_usd AS DOUBLE) AS revenue_usd, CAST(gross_revenue_usd AS DOUBLE) AS gross_revenue_usd,
           CAST(cum_ltv AS DOUBLE) AS cum_ltv, CAST(cum_gross_ltv AS DOUBLE) AS cum_gross_ltv FROM ltv"""))
def _ltv(b: Bound):
    return ltv(b).select("user_id", "signup_month", "acquisition_source", "months_since_signup",
                         *[dbl(c).alias(c) for c in ("revenue_usd", "gross_revenue_usd", "cum_ltv", "cum_gross_ltv")])


@query("user_monthly_ltv_all_streams", with_views("""
    SELECT user_id, signup_month, acquisition_source, months_since_signup,
           CAST(revenue_usd AS DOUBLE) AS revenue_usd, CAST(gross_revenue_usd AS DOUBLE) AS gross_revenue_usd,
           CAST(cum_ltv AS DOUBLE) AS cum_ltv, CAST(cum_gross_ltv AS DOUBLE) AS cum_gross_ltv FROM ltv_all""", "ltv_all"))
def _ltv_all(b: Bound):
    return ltv(b, "all_streams").select("user_id", "signup_month", "acquisition_source", "months_since_signup",
                                        *[dbl(c).alias(c) for c in ("revenue_usd", "gross_revenue_usd", "cum_ltv",
                                                                    "cum_gross_ltv")])


@query("kyc_first_month_deduction", _lq(
    "SELECT user_id, months_since_signup, kyc_deducted FROM ltv"))
def _kyc(b: Bound):
    return ltv(b).select("user_id", "months_since_signup", "kyc_deducted")


_LTV_SQL = """
    SELECT c.signup_month, c.months_since_signup, round(CAST(c.s AS DOUBLE) / CAST(a.n_active_users AS DOUBLE), 6) AS ltv_usd
    FROM (SELECT signup_month, months_since_signup, sum({v}) AS s FROM ltv GROUP BY 1, 2) c
    JOIN ltv_active a ON a.signup_month = c.signup_month"""


@query("cohort_ltv", _lq(_LTV_SQL.format(v="cum_ltv"), "ltv_active"))
def _cohort_ltv(b: Bound):
    return cohorts.cohort_ltv(ltv(b))


@query("cohort_ltv_gross", _lq(_LTV_SQL.format(v="cum_gross_ltv"), "ltv_active"))
def _cohort_ltv_gross(b: Bound):
    return cohorts.cohort_ltv(ltv(b), "cum_gross_ltv")


@query("cohort_total_profit", _lq("""
    SELECT signup_month, months_since_signup, CAST(sum(cum_ltv) AS DOUBLE) AS total_profit_usd
    FROM ltv GROUP BY 1, 2"""))
def _cohort_total(b: Bound):
    return cohorts.cohort_total_profit(ltv(b))


@query("cohort_active_users", _lq("""
    SELECT signup_month, months_since_signup, count(DISTINCT user_id) AS active_users FROM ltv GROUP BY 1, 2"""))
def _cohort_active(b: Bound):
    return cohorts.cohort_active_users(ltv(b))


register("ret", """
    SELECT c.signup_month, c.months_since_signup,
           round(CAST(c.active_users AS DOUBLE) / CAST(a.n_active_users AS DOUBLE), 6) AS retention
    FROM (SELECT signup_month, months_since_signup, count(DISTINCT user_id) AS active_users FROM ltv GROUP BY 1, 2) c
    JOIN ltv_active a ON a.signup_month = c.signup_month""", ["ltv", "ltv_active"])


@query("cohort_retention", with_views("SELECT * FROM ret", "ret"))
def _cohort_ret(b: Bound):
    return cohorts.cohort_retention(ltv(b))


@query("retention_average", with_views(f"""
    SELECT months_since_signup, round(CAST(sum(r) AS DOUBLE) / count(r), 6) AS avg_retention,
           round(CAST(sum(l) AS DOUBLE) / count(l), 6) AS avg_ltv_usd, count(*) AS n_cohorts,
           round(round(CAST(sum(l) AS DOUBLE) / count(l), 6) / 25.0, 6) AS ltv_to_cac
    FROM (SELECT c.months_since_signup,
                 CAST(CAST(c.act AS DOUBLE) / CAST(a.n_active_users AS DOUBLE) AS DECIMAL(30,10)) AS r,
                 CAST(CAST(c.s AS DOUBLE) / CAST(a.n_active_users AS DOUBLE) AS DECIMAL(30,10)) AS l
          FROM (SELECT signup_month, months_since_signup, count(DISTINCT user_id) AS act, sum(cum_ltv) AS s
                FROM ltv GROUP BY 1, 2) c JOIN ltv_active a ON a.signup_month = c.signup_month)
    GROUP BY 1""", "ltv", "ltv_active"))
def _ret_avg(b: Bound):
    return cohorts.retention_average(ltv(b), cac_usd=25.0)


@query("cohort_summary", _lq("""
    SELECT strftime(s.signup_month, '%Y-%m') AS cohort_month, n_users, a.n_active_users,
           CAST(g AS DOUBLE) AS total_gross_revenue_usd, CAST(n AS DOUBLE) AS total_net_revenue_usd,
           CAST(cf AS DOUBLE) AS total_card_fee_usd, CAST(bl AS DOUBLE) AS total_billing_usd,
           CAST(sw AS DOUBLE) AS total_swap_fee_usd, CAST(g - cf - bl - sw AS DOUBLE) AS total_conversion_revenue_usd,
           months_observed,
           round(CAST(g AS DOUBLE) / CAST(NULLIF(a.n_active_users, 0) AS DOUBLE), 6) AS avg_gross_per_user_usd,
           round(CAST(n AS DOUBLE) / CAST(NULLIF(a.n_active_users, 0) AS DOUBLE), 6) AS avg_net_per_user_usd,
           round(CAST((g - n) * 100 AS DOUBLE) / NULLIF(CAST(g AS DOUBLE), 0), 6) AS cost_load_pct
    FROM (SELECT signup_month, count(DISTINCT user_id) AS n_users, CAST(sum(gross_revenue_usd) AS DECIMAL(28,10)) AS g,
                 CAST(sum(revenue_usd) AS DECIMAL(28,10)) AS n, CAST(sum(card_fee_usd) AS DECIMAL(28,10)) AS cf,
                 CAST(sum(billing_usd) AS DECIMAL(28,10)) AS bl, CAST(sum(swap_fee_usd) AS DECIMAL(28,10)) AS sw,
                 max(months_since_signup) AS months_observed FROM ltv GROUP BY 1) s
    JOIN ltv_active a ON a.signup_month = s.signup_month""", "ltv_active"))
def _cohort_summary(b: Bound):
    return cohorts.cohort_summary(ltv(b))


@query("cohort_avg_dau", with_views("""
    SELECT signup_month, months_since_signup, round(avg(dau), 6) AS avg_dau FROM (
      SELECT signup_month, months_since_signup, activity_date, count(DISTINCT d.user_id) AS dau FROM (
        SELECT a.user_id, a.activity_date, CAST(date_trunc('month', b.signup_date) AS DATE) AS signup_month,
               CAST((year(a.activity_date) * 12 + month(a.activity_date))
                    - (year(b.signup_date) * 12 + month(b.signup_date)) AS BIGINT) AS months_since_signup
        FROM daily_act a JOIN cohort_base b ON a.user_id = b.user_id) d
      WHERE months_since_signup >= 0 GROUP BY 1, 2, 3) GROUP BY 1, 2""", "daily_act", "cohort_base"))
def _cohort_dau(b: Bound):
    return cohorts.cohort_avg_dau(daily_activity(b), cohort_base(b))


@query("cohort_monthly_profit", _lq("""
    WITH s AS (SELECT CAST(signup_month + to_months(CAST(months_since_signup AS INTEGER)) AS DATE) AS calendar_month,
                      signup_month, sum(revenue_usd) AS v FROM ltv GROUP BY 1, 2),
         g AS (SELECT m.calendar_month, c.signup_month FROM (SELECT DISTINCT calendar_month FROM s) m
               CROSS JOIN (SELECT DISTINCT signup_month FROM s) c)
    SELECT g.calendar_month, g.signup_month, CAST(coalesce(s.v, 0) AS DOUBLE) AS net_profit_usd
    FROM g LEFT JOIN s ON s.calendar_month = g.calendar_month AND s.signup_month = g.signup_month"""))
def _cohort_monthly(b: Bound):
    return cohorts.cohort_monthly_profit(ltv(b))


@query("ltv_by_source", _lq("""
    SELECT acquisition_source, months_since_signup, round(CAST(sum(m) AS DOUBLE) / count(m), 6) AS avg_cum_ltv_usd,
           count(*) AS n_cohorts
    FROM (SELECT acquisition_source, signup_month, months_since_signup,
                 CAST(CAST(sum(cum_ltv) AS DOUBLE) / count(cum_ltv) AS DECIMAL(30,10)) AS m
          FROM ltv GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def _ltv_source(b: Bound):
    return cohorts.ltv_by_source(ltv(b))


@query("cac_breakeven", _lq("""
    SELECT acquisition_source, min(CASE WHEN m >= 25.0 THEN months_since_signup END) AS payback_months,
           round(max(CASE WHEN months_since_signup <= 12 THEN CAST(m AS DOUBLE) END), 6) AS ltv_at_month_12
    FROM (SELECT acquisition_source, months_since_signup, sum(cum_ltv) / count(cum_ltv) AS m
          FROM ltv GROUP BY 1, 2) GROUP BY 1"""))
def _cac_breakeven(b: Bound):
    return cohorts.cac_breakeven(ltv(b), 25.0)


# ---------------------------------------------------------------- segments
def classified(b: Bound):
    return segments.classify_segments(master(b))


register("classified", """
    SELECT m.*, CASE WHEN days_since_last_active <= 30 AND CAST(net_revenue_usd AS DOUBLE) >= t.thr THEN 'champion'
                     WHEN days_since_last_active <= 30 AND CAST(net_revenue_usd AS DOUBLE) < t.thr THEN 'active'
                     WHEN days_since_last_active > 30 AND days_since_last_active <= 90 THEN 'at_risk'
                     ELSE 'dormant' END AS segment
    FROM master m CROSS JOIN (SELECT quantile_cont(CAST(net_revenue_usd AS DOUBLE), 0.8) AS thr FROM master) t""",
         ["master"])


@query("classify_segments", with_views(
    "SELECT user_id, CAST(net_revenue_usd AS DOUBLE) AS net_revenue_usd, days_since_last_active, segment "
    "FROM classified", "classified"))
def _classify(b: Bound):
    return classified(b).select("user_id", dbl("net_revenue_usd").alias("net_revenue_usd"),
                                "days_since_last_active", "segment")


@query("segment_summary", with_views("""
    SELECT segment, n_users, avg_net_revenue_usd, total_net_revenue_usd,
           round(CAST(n_users AS DOUBLE) / sum(n_users) OVER (), 6) AS pct_users
    FROM (SELECT segment, count(user_id) AS n_users,
                 round(CAST(sum(net_revenue_usd) AS DOUBLE) / count(net_revenue_usd), 6) AS avg_net_revenue_usd,
                 CAST(sum(net_revenue_usd) AS DOUBLE) AS total_net_revenue_usd FROM classified GROUP BY 1)""",
                                      "classified"))
def _seg_summary(b: Bound):
    return segments.segment_summary(classified(b))


@query("founders_vs_non_founders", with_views("""
    SELECT is_founder, count(user_id) AS n_users,
           round(CAST(sum(net_revenue_usd) AS DOUBLE) / count(net_revenue_usd), 6) AS avg_net_revenue_usd,
           round(CAST(count(*) FILTER (WHERE net_revenue_usd > 0) AS DOUBLE) / count(*), 6) AS pct_transacting,
           round(median(CAST(net_revenue_usd AS DOUBLE)), 6) AS median_net_revenue_usd
    FROM master GROUP BY 1""", "master"))
def _founders_vs(b: Bound):
    return segments.founders_vs_non_founders(master(b))


@query("referral_performance", with_views("""
    SELECT referral_code, n_users, round(a, 6) AS avg_revenue, commission_rate_bps,
           round(greatest(a * CAST(commission_rate_bps AS DOUBLE) / 10000.0, 0.0), 6) AS commission_cost_usd,
           round(a - greatest(a * CAST(commission_rate_bps AS DOUBLE) / 10000.0, 0.0), 6) AS net_value_usd,
           round(CAST(nc AS DOUBLE) / n_users, 6) AS pct_champion, round(CAST(na AS DOUBLE) / n_users, 6) AS pct_active,
           round(CAST(nr AS DOUBLE) / n_users, 6) AS pct_at_risk, round(CAST(nd AS DOUBLE) / n_users, 6) AS pct_dormant
    FROM (SELECT referral_code, count(user_id) AS n_users, CAST(sum(net_revenue_usd) / count(net_revenue_usd) AS DOUBLE) AS a,
                 min(commission_rate_bps) AS commission_rate_bps,
                 count(*) FILTER (WHERE segment = 'champion') AS nc, count(*) FILTER (WHERE segment = 'active') AS na,
                 count(*) FILTER (WHERE segment = 'at_risk') AS nr, count(*) FILTER (WHERE segment = 'dormant') AS nd
          FROM classified WHERE referral_code IS NOT NULL AND referral_code <> '' GROUP BY 1)""", "classified"))
def _ref_perf(b: Bound):
    return segments.referral_performance(classified(b))


#: Columns of the master table that ``users.product_flags`` reads.
PRODUCT_COLUMNS = ("n_conversions", "onramp_volume_brl", "offramp_volume_usdc", "card_fee_usd", "card_tx_fee_usd", "n_swaps",
                   "payout_fee_usd")


@query("adoption_by_segment", with_views("""
    SELECT c.segment, round(avg(CAST(a.has_conversion AS DOUBLE)), 6) AS has_conversion,
           round(avg(CAST(a.has_card AS DOUBLE)), 6) AS has_card, round(avg(CAST(a.has_swap AS DOUBLE)), 6) AS has_swap,
           round(avg(CAST(a.has_crossborder AS DOUBLE)), 6) AS has_crossborder
    FROM classified c JOIN adoption a ON a.user_id = c.user_id GROUP BY 1""", "classified", "adoption"))
def _adoption_seg(b: Bound):
    # Read three times: for the threshold, the segments and the products.
    m = written_table(master(b).select("user_id", "net_revenue_usd", "days_since_last_active", *PRODUCT_COLUMNS), "adoption")
    return segments.adoption_by_segment(segments.classify_segments(m), users.product_adoption(m, mask=False))
