"""Campaign queries: spend, windows, cohort ROI, daily cohort revenue, profit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl, fine, money, nz, safe_div, scale_minor_units
from ..operators import campaigns as cp
from ..operators import ramp, users
from ..sources.binding import AS_OF, FULL_END, FULL_START, Bound, once
from .oracle_views import register, with_views
from .ramp_plans import conversions
from .registry import query
from .user_plans import fx_rate, transacting_sources

AS_OF_DATE = AS_OF[:10]


@once
def spend(b: Bound):
    return cp.load_ad_spend(b.expense_export)


@once
def spend_daily(b: Bound):
    return cp.aggregate_spend(spend(b))


@once
def campaigns(b: Bound):
    """Campaign windows: a calendar-bounded table (broadcast side of the range joins)."""
    return cp.detect_campaigns(spend_daily(b), 7)


@once
def signups_daily(b: Bound):
    return users.daily_signups(b.app_users, "created_at", FULL_START, FULL_END)


@once
def cohort(b: Bound):
    """user -> campaign for users who signed up inside a window (at most one row per user)."""
    return cp.assign_cohort(b.app_users, campaigns(b))


REVENUE_STREAMS = ("card_fee_usd", "billing_usd", "swap_fee_usd", "cashback_usd", "revenue_share_usd")


@once
def user_revenue(b: Bound):
    q = scale_minor_units(b.conversion_quotes).where(F.col("used"))
    conv = q.groupBy("user_id").agg(money(F.sum(nz("fee_amount_brl") + nz("spread_revenue_brl"))).alias("brl"),
                                    money(F.sum(nz("fee_amount_usdc") + nz("spread_revenue_usdc"))).alias("usdc"))
    return cp.user_revenue(conv, users.ledger_sums(b.card_ledger, REVENUE_STREAMS), fx_all(b))


@once
def fx_all(b: Bound):
    return ramp.fx_rate_median(scale_minor_units(b.conversion_quotes))


@once
def transacting(b: Bound):
    return users.distinct_users(transacting_sources(b)).select(F.col("user_id").cast("bigint").alias("user_id"))


@once
def summary(b: Bound):
    return cp.cohort_revenue_summary(cohort(b), user_revenue(b), transacting(b))


def roi(b: Bound):
    return cp.campaign_roi(campaigns(b), summary(b), cp.baseline_rate(signups_daily(b), campaigns(b), 7))


def signed_rows(b: Bound):
    c = cohort(b)
    fx = fx_all(b)
    q = scale_minor_units(b.conversion_quotes).where(F.col("used")).crossJoin(F.broadcast(fx))
    conv = q.select("user_id", F.to_date("created_at").alias("rev_date"),
                    money(nz(fine(safe_div(nz("fee_amount_brl") + nz("spread_revenue_brl"),
                                           F.nullif(F.col("fx_rate"), F.lit(0)))))
                          + nz("fee_amount_usdc") + nz("spread_revenue_usdc")).alias("rev_usd"),
                    F.lit("conversion").alias("src"))
    signs = {"card_fee": F.col("card_fee_usd"), "billing": F.col("billing_usd"), "swap": F.col("swap_fee_usd"),
             "cashback": -F.col("cashback_usd"), "rev_share": -F.col("revenue_share_usd")}
    events = F.array(*[F.struct(money(v).alias("rev_usd"), F.lit(k).alias("src")) for k, v in signs.items()])
    other = users.ledger_rows(b.card_ledger, REVENUE_STREAMS).select(
        "user_id", F.to_date("ts").alias("rev_date"), F.inline(events)).where(F.col("rev_usd").isNotNull())
    return cp.cohort_semi_join(conv.unionByName(other), c.select("user_id", "campaign_id"))


def daily_rev(b: Bound):
    return cp.cohort_daily_revenue(signed_rows(b))


@once
def cum_rev(b: Bound):
    return cp.cumulative_revenue(daily_rev(b), campaigns(b), AS_OF_DATE)


def daily_counts(b: Bound):
    c = cohort(b)
    tx = cp.cohort_semi_join(b.card_transactions.where(F.col("status").isin("completed", "pending")
                                                       & (F.col("transaction_type") == "spend")), c)
    tx = tx.where(F.col("posted_at") >= F.col("start")).groupBy("campaign_id", F.to_date("posted_at").alias("date")) \
        .agg(F.count(F.lit(1)).alias("txn_count"))
    cv = cp.cohort_semi_join(b.conversion_quotes.where(F.col("used")), c)
    cv = cv.where(F.col("created_at") >= F.col("start")).groupBy("campaign_id", F.to_date("created_at").alias("date")) \
        .agg(F.count(F.lit(1)).alias("conv_count"))
    ky = cp.cohort_semi_join(b.app_users.where(F.col("kyc_level") >= 1), c)
    ky = ky.groupBy("campaign_id", F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("kyc_count"))
    return tx, cv, ky


def invoice_history(b: Bound):
    """Unit cost of every invoiced month; months without an invoice use the
    as-of rule."""
    return cp.unit_cost_by_period(b.card_invoices)


def profit(b: Bound):
    tx, cv, ky = daily_counts(b)
    return cp.cumulative_profit(cum_rev(b), tx, cv, ky, spend_daily(b), invoice_history(b))


# ------------------------------------------------------------------ SQL side
register("spend", """
    SELECT "date", platform, CAST(sum(abs(amount)) AS DECIMAL(28,10)) AS daily_spend_usd FROM (
        SELECT "date", amount, CASE WHEN merchantName LIKE 'FACEBK%' THEN 'meta'
                                    WHEN lower(merchantName) LIKE '%google ads%' THEN 'google' END AS platform
        FROM expense_export) WHERE platform IS NOT NULL GROUP BY 1, 2""", ["expense_export"])
register("spend_daily", """
    SELECT "date", CAST(sum(daily_spend_usd) AS DECIMAL(28,10)) AS daily_spend_usd FROM spend GROUP BY 1""",
         ["spend"])
register("campaigns", """
    SELECT 'campaign_' || CAST(island AS VARCHAR) AS campaign_id, min("date") AS start, max("date") AS "end",
           CAST(sum(daily_spend_usd) AS DECIMAL(28,10)) AS total_spend_usd
    FROM (SELECT *, sum(CASE WHEN prev IS NULL OR datediff('day', prev, "date") > 7 THEN 1 ELSE 0 END)
                        OVER (ORDER BY "date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM (SELECT *, lag("date") OVER (ORDER BY "date") AS prev FROM spend_daily))
    GROUP BY island""", ["spend_daily"])
register("signups_daily", """
    SELECT CAST(created_at AS DATE) AS signup_date, count(*) AS new_signups FROM app_users
    WHERE created_at IS NOT NULL
    GROUP BY 1""", ["app_users"])
register("cohort", """
    SELECT u.user_id, c.campaign_id, c.start FROM app_users u JOIN campaigns c
      ON CAST(u.created_at AS DATE) >= c.start AND CAST(u.created_at AS DATE) <= c."end" """,
         ["app_users", "campaigns"])
register("fx_all", """
    SELECT coalesce(round(quantile_cont(CAST(effective_rate AS DOUBLE), 0.5), 6), 5.8) AS fx_rate FROM conversions
    WHERE used = TRUE AND direction = 'brl_to_usdc'""", ["conversions"])
_SWAP = """CASE WHEN input_mint = 'USDC' THEN CAST(input_amount AS DECIMAL(20,0)) * CAST(platform_fee_bps AS DECIMAL(5,0)) * 0.0000000001
                WHEN output_mint = 'USDC' THEN CAST(output_amount AS DECIMAL(20,0)) * CAST(platform_fee_bps AS DECIMAL(5,0)) * 0.0000000001
                ELSE 0 END"""
register("user_rev", f"""
    WITH cv AS (SELECT user_id, CAST(sum(coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0)) AS DECIMAL(28,10)) AS brl,
                       CAST(sum(coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0)) AS DECIMAL(28,10)) AS usdc
                FROM conversions WHERE used = TRUE GROUP BY 1),
         o AS (SELECT user_id, CAST(CAST(CAST(brl AS DOUBLE) / fx_rate AS DECIMAL(30,10)) + coalesce(usdc, 0) AS DECIMAL(28,10)) AS v
               FROM cv CROSS JOIN fx_all),
         cf AS (SELECT user_id, CAST(sum(amount_usdc) AS DECIMAL(28,10)) AS v FROM card_annual_fees WHERE status = 'paid' GROUP BY 1),
         bl AS (SELECT user_id, CAST(sum(CAST(amount AS DECIMAL(20,0)) * 0.000001) AS DECIMAL(28,10)) AS v FROM billing_charges
                WHERE status = 'settled' GROUP BY 1),
         sw AS (SELECT user_id, CAST(sum({_SWAP}) AS DECIMAL(28,10)) AS v FROM swap_transactions GROUP BY 1),
         cb AS (SELECT user_id, CAST(sum(reward_usd_value) AS DECIMAL(28,10)) AS v FROM cashback_rewards WHERE status = 'completed' GROUP BY 1),
         rs AS (SELECT source_user_id AS user_id, CAST(sum(reward_usd_value) AS DECIMAL(28,10)) AS v FROM revenue_share_rewards
                WHERE status = 'completed' GROUP BY 1),
         ids AS (SELECT user_id FROM o UNION SELECT user_id FROM cf UNION SELECT user_id FROM bl UNION SELECT user_id FROM sw
                 UNION SELECT user_id FROM cb UNION SELECT user_id FROM rs),
         j AS (SELECT ids.user_id, coalesce(o.v, 0) AS onramp_rev_usd, coalesce(cf.v, 0) AS card_fee_usd,
                      coalesce(bl.v, 0) AS billing_usd, CAST(0 AS DECIMAL(28,10)) AS swap_fee_usd,
                      coalesce(cb.v, 0) AS cashback_usd, coalesce(rs.v, 0) AS revenue_share_usd
               FROM ids LEFT JOIN o USING (user_id) LEFT JOIN cf USING (user_id) LEFT JOIN bl USING (user_id)
               LEFT JOIN sw USING (user_id) LEFT JOIN cb USING (user_id) LEFT JOIN rs USING (user_id))
    SELECT *, onramp_rev_usd + card_fee_usd + billing_usd + swap_fee_usd - cashback_usd - revenue_share_usd AS total_revenue_usd
    FROM j""", ["conversions", "fx_all", "card_annual_fees", "billing_charges", "swap_transactions", "cashback_rewards",
                "revenue_share_rewards"])
register("transacting", """
    SELECT DISTINCT user_id FROM (SELECT user_id FROM conversion_quotes WHERE used = TRUE
      UNION ALL SELECT user_id FROM card_annual_fees WHERE status = 'paid'
      UNION ALL SELECT user_id FROM billing_charges WHERE status = 'settled'
      UNION ALL SELECT user_id FROM swap_transactions
      UNION ALL SELECT user_id FROM payouts WHERE status = 'completed')""",
         ["conversion_quotes", "card_annual_fees", "billing_charges", "swap_transactions", "payouts"])


def _r(x: str, d: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), {d}) AS DOUBLE)"


_REV = ["onramp_rev_usd", "card_fee_usd", "billing_usd", "swap_fee_usd", "cashback_usd", "revenue_share_usd",
        "total_revenue_usd"]
register("crs", """
    SELECT c.campaign_id, count(DISTINCT c.user_id) AS cohort_users, count(DISTINCT t.user_id) AS transacting_users, """
         + ", ".join(f"{_r(f'coalesce(sum(r.{x}), 0)', 4)} AS {x}" for x in _REV) + """
    FROM cohort c LEFT JOIN user_rev r ON r.user_id = c.user_id LEFT JOIN transacting t ON t.user_id = c.user_id
    GROUP BY 1""", ["cohort", "user_rev", "transacting"])
register("baseline", """
    SELECT c.campaign_id, CASE WHEN coalesce(b.s, 0) > 0 THEN b.m ELSE 0.0 END AS baseline
    FROM campaigns c LEFT JOIN (
        SELECT c.campaign_id, CAST(sum(new_signups) AS DOUBLE) / count(new_signups) AS m, sum(new_signups) AS s
        FROM signups_daily d JOIN campaigns c ON d.signup_date >= c.start - INTERVAL 7 DAY AND d.signup_date < c.start
        GROUP BY 1) b ON b.campaign_id = c.campaign_id""", ["campaigns", "signups_daily"])
register("roi", f"""
    SELECT campaign_id, start, "end", dur AS duration_days, {_r('total_spend_usd', 2)} AS total_spend_usd,
           CAST(u AS BIGINT) AS cohort_users, CAST(tx AS BIGINT) AS transacting_users,
           CASE WHEN u > 0 THEN {_r('CAST(tx AS DOUBLE) / CAST(u AS DOUBLE)', 4)} END AS transacting_rate,
           {_r('baseline', 1)} AS baseline_rate_per_day, {_r('incr', 0)} AS incremental_users_est,
           {_r('rev', 2)} AS total_revenue_usd,
           CASE WHEN sp > 0 THEN {_r('CAST(rev AS DOUBLE) / sp', 4)} END AS roas,
           CASE WHEN tx > 0 THEN {_r('sp / CAST(tx AS DOUBLE)', 2)} END AS cac_full,
           CASE WHEN incr > 0 THEN {_r('sp / incr', 2)} END AS cac_incremental,
           CASE WHEN tx > 0 THEN {_r('CAST(rev AS DOUBLE) / CAST(tx AS DOUBLE)', 2)} END AS avg_rev_per_transacting_user
    FROM (SELECT c.campaign_id, c.start, c."end", c.total_spend_usd, CAST(datediff('day', c.start, c."end") + 1 AS BIGINT) AS dur,
                 coalesce(s.cohort_users, 0) AS u, coalesce(s.transacting_users, 0) AS tx, coalesce(s.total_revenue_usd, 0) AS rev,
                 CAST(c.total_spend_usd AS DOUBLE) AS sp, b.baseline,
                 greatest(CAST(coalesce(s.cohort_users, 0) AS DOUBLE) - b.baseline * (datediff('day', c.start, c."end") + 1), 0.0) AS incr
          FROM campaigns c LEFT JOIN crs s ON s.campaign_id = c.campaign_id LEFT JOIN baseline b ON b.campaign_id = c.campaign_id)""",
         ["campaigns", "crs", "baseline"])
register("signed", f"""
    SELECT c.campaign_id, x.rev_date, x.rev_usd, x.src FROM (
      SELECT user_id, CAST(created_at AS DATE) AS rev_date,
             CAST(coalesce(CAST(CAST(CAST(coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0) AS DOUBLE)
                                / NULLIF(fx_rate, 0) AS VARCHAR) AS DECIMAL(30,10)), 0)
                  + coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0) AS DECIMAL(28,10)) AS rev_usd,
             'conversion' AS src FROM conversions CROSS JOIN fx_all WHERE used = TRUE
      UNION ALL SELECT user_id, CAST(created_at AS DATE), CAST(amount_usdc AS DECIMAL(28,10)), 'card_fee'
        FROM card_annual_fees WHERE status = 'paid'
      UNION ALL SELECT user_id, CAST(created_at AS DATE), CAST(CAST(amount AS DECIMAL(20,0)) * 0.000001 AS DECIMAL(28,10)), 'billing'
        FROM billing_charges WHERE status = 'settled'
      UNION ALL SELECT user_id, CAST("timestamp" AS DATE), CAST({_SWAP} AS DECIMAL(28,10)), 'swap' FROM swap_transactions
      UNION ALL SELECT user_id, CAST(created_at AS DATE), CAST(-reward_usd_value AS DECIMAL(28,10)), 'cashback'
        FROM cashback_rewards WHERE status = 'completed'
      UNION ALL SELECT source_user_id, CAST(created_at AS DATE), CAST(-reward_usd_value AS DECIMAL(28,10)), 'rev_share'
        FROM revenue_share_rewards WHERE status = 'completed') x
    JOIN cohort c ON c.user_id = x.user_id""",
         ["conversions", "fx_all", "card_annual_fees", "billing_charges", "swap_transactions", "cashback_rewards",
          "revenue_share_rewards", "cohort"])
_SRC = [("conversion", "daily_rev_conversion_usd", ""), ("card_fee", "daily_rev_card_fees_usd", ""),
        ("billing", "daily_rev_billing_usd", ""), ("swap", "daily_rev_swap_usd", ""),
        ("cashback", "daily_cost_cashback_usd", "-"), ("rev_share", "daily_cost_rev_share_usd", "-")]
register("daily_rev", "SELECT campaign_id, rev_date, " + ", ".join(
    f"{_r(sg + 'CAST(sum(CASE WHEN src = ' + chr(39) + k + chr(39) + ' THEN rev_usd ELSE 0 END) AS DECIMAL(28,10))', 4)} AS {n}"
    for k, n, sg in _SRC) + f", {_r('sum(rev_usd)', 4)} AS daily_rev_usd FROM signed GROUP BY 1, 2", ["signed"])
_DAILY = [n for _, n, _ in _SRC] + ["daily_rev_usd"]
register("spine", f"""
    SELECT campaign_id, CAST(unnest(generate_series(start, greatest(DATE '{AS_OF_DATE}', start), INTERVAL 1 DAY)) AS DATE) AS "date"
    FROM campaigns""", ["campaigns"])
register("cum_rev", """
    SELECT campaign_id, "date", daily_rev_conversion_usd, daily_rev_card_fees_usd, daily_rev_billing_usd,
           CAST(0.0 AS DOUBLE) AS daily_rev_swap_usd, daily_cost_cashback_usd, daily_cost_rev_share_usd,
           daily_rev_usd - daily_rev_swap_usd AS daily_rev_usd,
           """ + _r("""sum(CAST(daily_rev_usd - daily_rev_swap_usd AS DECIMAL(30,10))) OVER (PARTITION BY campaign_id ORDER BY "date"
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", 4) + """ AS cum_rev_usd
    FROM (SELECT s.campaign_id, s."date", """ + ", ".join(f"coalesce(d.{c}, 0.0) AS {c}" for c in _DAILY) + """
          FROM spine s LEFT JOIN daily_rev d ON d.campaign_id = s.campaign_id AND d.rev_date = s."date")""",
         ["spine", "daily_rev"])
register("cnt_tx", """
    SELECT c.campaign_id, CAST(t.posted_at AS DATE) AS "date", count(*) AS txn_count FROM card_transactions t
    JOIN cohort c ON c.user_id = t.user_id
    WHERE t.status IN ('completed', 'pending') AND t.transaction_type = 'spend' AND t.posted_at >= c.start GROUP BY 1, 2""",
         ["card_transactions", "cohort"])
register("cnt_cv", """
    SELECT c.campaign_id, CAST(q.created_at AS DATE) AS "date", count(*) AS conv_count FROM conversion_quotes q
    JOIN cohort c ON c.user_id = q.user_id WHERE q.used = TRUE AND q.created_at >= c.start GROUP BY 1, 2""",
         ["conversion_quotes", "cohort"])
register("cnt_kyc", """
    SELECT c.campaign_id, CAST(u.created_at AS DATE) AS "date", count(*) AS kyc_count FROM app_users u
    JOIN cohort c ON c.user_id = u.user_id WHERE u.kyc_level >= 1 GROUP BY 1, 2""", ["app_users", "cohort"])
register("unit_costs", """
    SELECT period, CAST(CAST(t AS DOUBLE) / CAST(n AS DOUBLE) AS DECIMAL(30,10)) AS cost_per_txn FROM (
      SELECT period, sum(invoice_total_usd) AS t, sum(n_transactions) AS n FROM card_invoices GROUP BY 1) WHERE n > 0""", ["card_invoices"])
_PROFIT_DAILY = ["daily_rev_conversion_usd", "daily_rev_card_fees_usd", "daily_rev_billing_usd", "daily_rev_swap_usd",
                 "daily_cost_cashback_usd", "daily_cost_rev_share_usd", "daily_rev_total_usd", "daily_card_cogs_usd",
                 "daily_ad_spend_usd", "daily_kyc_cost_usd", "daily_contribution_margin_usd", "daily_profit_usd"]
_PROFIT_CUM = [("cum_rev_conversion_usd", "daily_rev_conversion_usd"),
               ("cum_rev_card_fees_usd", "daily_rev_card_fees_usd"), ("cum_rev_billing_usd", "daily_rev_billing_usd"),
               ("cum_rev_swap_usd", "daily_rev_swap_usd"), ("cum_cost_cashback_usd", "daily_cost_cashback_usd"),
               ("cum_cost_rev_share_usd", "daily_cost_rev_share_usd"), ("cum_rev_usd", "daily_rev_total_usd"),
               ("cum_card_cogs_usd", "daily_card_cogs_usd"), ("cum_kyc_cost_usd", "daily_kyc_cost_usd"),
               ("cum_contribution_margin_usd", "daily_contribution_margin_usd"),
               ("cum_profit_usd", "daily_profit_usd")]
_W = 'OVER (PARTITION BY campaign_id ORDER BY "date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'


def _asof_rate_sql(src: str) -> str:
    return f"""
     months AS (SELECT DISTINCT strftime("date", '%Y-%m') AS m FROM {src}),
     back AS (SELECT months.m, arg_max(u.cost_per_txn, u.period) AS back FROM months
              LEFT JOIN unit_costs u ON u.period <= months.m GROUP BY 1),
     first_ AS (SELECT arg_min(cost_per_txn, period) AS f FROM unit_costs),
     rate AS (SELECT m, coalesce(back, f) AS rate FROM back CROSS JOIN first_)"""


register("profit", """
    WITH b AS (
      SELECT r.*, CAST(coalesce(t.txn_count, 0) AS BIGINT) AS daily_txn_count,
             CAST(coalesce(v.conv_count, 0) AS BIGINT) AS daily_conversion_count,
             CAST(coalesce(k.kyc_count, 0) AS BIGINT) AS kyc_n,
             CAST(coalesce(s.daily_spend_usd, 0) AS DOUBLE) AS daily_ad_spend_usd
      FROM cum_rev r LEFT JOIN cnt_tx t ON t.campaign_id = r.campaign_id AND t."date" = r."date"
      LEFT JOIN cnt_cv v ON v.campaign_id = r.campaign_id AND v."date" = r."date"
      LEFT JOIN cnt_kyc k ON k.campaign_id = r.campaign_id AND k."date" = r."date"
      LEFT JOIN spend_daily s ON s."date" = r."date"),""" + _asof_rate_sql("b") + """,
     c AS (SELECT b.*, daily_rev_usd AS daily_rev_total_usd,
                  CAST(CAST(coalesce(CAST(CAST(daily_txn_count AS DOUBLE) * CAST(rate.rate AS DOUBLE) AS DECIMAL(30,10)), 0)
                            AS DECIMAL(28,10)) AS DOUBLE) AS daily_card_cogs_usd,
                  CAST(kyc_n AS DOUBLE) * 2.07 AS daily_kyc_cost_usd
           FROM b LEFT JOIN rate ON rate.m = strftime(b."date", '%Y-%m')),
     e AS (SELECT *, daily_rev_total_usd - daily_card_cogs_usd - daily_kyc_cost_usd AS daily_profit_usd FROM c),
     f AS (SELECT *, daily_profit_usd - daily_ad_spend_usd AS daily_contribution_margin_usd FROM e)
    SELECT campaign_id, "date", """ + ", ".join(f"{_r(c, 4)} AS {c}" for c in _PROFIT_DAILY) + """,
           daily_txn_count, daily_conversion_count, """ + ", ".join(
    f"{_r(f'sum(CAST({src} AS DECIMAL(30,10))) {_W}', 4)} AS {name}" for name, src in _PROFIT_CUM) + f""",
           CAST(sum(daily_txn_count) {_W} AS BIGINT) AS cum_txn_count,
           CAST(sum(daily_conversion_count) {_W} AS BIGINT) AS cum_conversion_count
    FROM f""", ["cum_rev", "cnt_tx", "cnt_cv", "cnt_kyc", "spend_daily", "unit_costs"])


# ------------------------------------------------------------------ queries
@query("classify_merchant", with_views("""
    SELECT id, merchantName, CASE WHEN merchantName LIKE 'FACEBK%' THEN 'meta'
                                  WHEN lower(merchantName) LIKE '%google ads%' THEN 'google' END AS platform
    FROM expense_export""", "expense_export"))
def _classify_merchant(b: Bound):
    e = b.expense_export
    return e.select("id", "merchantName", cp.classify_merchant(F.col("merchantName")).alias("platform"))


@query("load_ad_spend", with_views(
    'SELECT "date", platform, CAST(daily_spend_usd AS DOUBLE) AS daily_spend_usd FROM spend', "spend"))
def _load_ad_spend(b: Bound):
    return spend(b).withColumn("daily_spend_usd", dbl("daily_spend_usd"))


@query("load_ad_spend_table", with_views("""
    WITH t AS (SELECT "date", platform, CAST(sum(daily_spend_usd) AS DECIMAL(28,10)) AS v FROM spend GROUP BY 1, 2),
         l AS (SELECT max("date") AS last FROM t WHERE lower(platform) = 'meta')
    SELECT "date", platform, CAST(CASE WHEN lower(platform) = 'meta' AND "date" = l.last
                                      THEN greatest(v - CAST(50.00 AS DECIMAL(20,2)), 0) ELSE v END AS DOUBLE) AS daily_spend_usd
    FROM t CROSS JOIN l""", "spend"))
def _load_ad_spend_table(b: Bound):
    stored = spend(b).select("date", "platform", F.col("daily_spend_usd").alias("amount_usd"))
    return cp.load_ad_spend_table(stored, adjustment=50.0).withColumn("daily_spend_usd", dbl("daily_spend_usd"))


@query("aggregate_spend", with_views(
    'SELECT "date", CAST(daily_spend_usd AS DOUBLE) AS daily_spend_usd FROM spend_daily', "spend_daily"))
def _aggregate_spend(b: Bound):
    return spend_daily(b).withColumn("daily_spend_usd", dbl("daily_spend_usd"))


@query("spend_by_platform", with_views("""
    SELECT platform, CAST(sum(daily_spend_usd) AS DOUBLE) AS total_spend_usd, count(DISTINCT "date") AS n_days
    FROM spend GROUP BY 1""", "spend"))
def _spend_by_platform(b: Bound):
    return cp.spend_by_platform(spend(b))


@query("detect_campaigns", with_views(
    'SELECT campaign_id, start, "end", CAST(total_spend_usd AS DOUBLE) AS total_spend_usd FROM campaigns', "campaigns"))
def _detect(b: Bound):
    return campaigns(b).withColumn("total_spend_usd", dbl("total_spend_usd"))


@query("detect_campaigns_by_user", with_views("""
    SELECT user_id, 'campaign_' || CAST(island AS VARCHAR) AS campaign_id, min("date") AS start, max("date") AS "end",
           CAST(sum(v) AS DOUBLE) AS total_spend_usd
    FROM (SELECT *, sum(CASE WHEN prev IS NULL OR datediff('day', prev, "date") > 7 THEN 1 ELSE 0 END)
                        OVER (PARTITION BY user_id ORDER BY "date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
          FROM (SELECT *, lag("date") OVER (PARTITION BY user_id ORDER BY "date") AS prev FROM (
                  SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS "date",
                         sum(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001) AS v FROM orders GROUP BY 1, 2)))
    GROUP BY user_id, island"""))
def _detect_by_user(b: Bound):
    o = b.table("orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date"),
                                 (F.col("o_totalprice").cast("decimal(18,2)") * F.expr("0.001")).alias("v"))
    return cp.detect_campaigns(o, 7, keys=("user_id",), value="v").withColumn("total_spend_usd",
                                                                            dbl("total_spend_usd"))


@query("tag_campaign_window", with_views("""
    SELECT d.signup_date, d.new_signups, t.cid IS NOT NULL AS is_campaign, coalesce(t.cid, '') AS campaign_id
    FROM signups_daily d LEFT JOIN (
        SELECT d.signup_date AS dd, arg_max(c.campaign_id, c.start) AS cid FROM signups_daily d
        JOIN campaigns c ON d.signup_date >= c.start AND d.signup_date <= c."end" GROUP BY 1) t ON t.dd = d.signup_date""",
                                         "signups_daily", "campaigns"))
def _tag(b: Bound):
    return cp.tag_campaign_window(signups_daily(b), campaigns(b), "signup_date")


@query("daily_context", with_views("""
    WITH s AS (SELECT d.signup_date AS "date", d.new_signups, CAST(coalesce(sd.daily_spend_usd, 0) AS DOUBLE) AS daily_spend_usd
               FROM signups_daily d LEFT JOIN spend_daily sd ON sd."date" = d.signup_date
               WHERE d.signup_date >= (SELECT min(start) FROM campaigns) - INTERVAL 14 DAY)
    SELECT s.*, t.cid IS NOT NULL AS is_campaign, coalesce(t.cid, '') AS campaign_id
    FROM s LEFT JOIN (SELECT s."date" AS dd, arg_max(c.campaign_id, c.start) AS cid FROM s
                      JOIN campaigns c ON s."date" >= c.start AND s."date" <= c."end" GROUP BY 1) t ON t.dd = s."date" """,
                                   "signups_daily", "spend_daily", "campaigns"))
def _daily_context(b: Bound):
    return cp.daily_context(signups_daily(b), spend_daily(b), campaigns(b), 14)


def referral_users(b: Bound, code: str):
    """Users attributed to a referral code (the optional cohort filter)."""
    rc = b.referral_codes.where(F.col("code") == code).select(F.col("id").alias("attributed_referral_code_id"))
    return b.user_registrations.join(rc, "attributed_referral_code_id", "left_semi").select("user_id")


@query("cohort_semi_join_referral", with_views("""
    SELECT c.campaign_id, q.id FROM conversion_quotes q
    JOIN (SELECT u.user_id, c.campaign_id, c.start FROM app_users u JOIN campaigns c
            ON CAST(u.created_at AS DATE) >= c.start AND CAST(u.created_at AS DATE) <= c."end"
          WHERE u.user_id IN (SELECT ur.user_id FROM user_registrations ur
                              JOIN referral_codes rc ON rc.id = ur.attributed_referral_code_id
                              WHERE rc.code = 'NATION_1')) c ON c.user_id = q.user_id
    WHERE q.used = TRUE AND q.created_at >= c.start""", "conversion_quotes", "app_users", "campaigns",
                                                "user_registrations", "referral_codes"))
def _semi_referral(b: Bound):
    c = cp.assign_cohort(b.app_users, campaigns(b), referral_users=referral_users(b, "NATION_1"))
    j = cp.cohort_semi_join(b.conversion_quotes.where(F.col("used")), c)
    return j.where(F.col("created_at") >= F.col("start")).select("campaign_id", "id")


@query("cohort_semi_join", with_views("""
    SELECT c.campaign_id, q.id FROM conversion_quotes q JOIN cohort c ON c.user_id = q.user_id
    WHERE q.used = TRUE AND q.created_at >= c.start""", "conversion_quotes", "cohort"))
def _semi(b: Bound):
    j = cp.cohort_semi_join(b.conversion_quotes.where(F.col("used")), cohort(b))
    return j.where(F.col("created_at") >= F.col("start")).select("campaign_id", "id")


@query("fx_scalar_join", with_views("""
    SELECT id, fx_rate, CAST(CAST(CAST(coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0) AS DOUBLE) / fx_rate
                                  AS DECIMAL(30,10)) AS DOUBLE) AS revenue_usd_at_median
    FROM conversions CROSS JOIN fx_all WHERE used = TRUE""", "conversions", "fx_all"))
def _fx_scalar(b: Bound):
    q = scale_minor_units(b.conversion_quotes).where(F.col("used")).crossJoin(F.broadcast(fx_all(b)))
    return q.select("id", "fx_rate", dbl(fine(safe_div(nz("fee_amount_brl") + nz("spread_revenue_brl"),
                                                       "fx_rate"))).alias("revenue_usd_at_median"))


@query("cohort_revenue_summary", with_views("SELECT * FROM crs", "crs"))
def _crs(b: Bound):
    return summary(b)


@query("campaign_roi", with_views("SELECT * FROM roi", "roi"))
def _roi(b: Bound):
    return roi(b)


@query("cohort_daily_revenue", with_views("SELECT * FROM daily_rev", "daily_rev"))
def _daily_rev(b: Bound):
    return daily_rev(b)


@query("cohort_daily_counts", with_views("""
    SELECT coalesce(t.campaign_id, v.campaign_id, k.campaign_id) AS campaign_id, coalesce(t."date", v."date", k."date") AS "date",
           CAST(coalesce(txn_count, 0) AS BIGINT) AS txn_count, CAST(coalesce(conv_count, 0) AS BIGINT) AS conv_count,
           CAST(coalesce(kyc_count, 0) AS BIGINT) AS kyc_count
    FROM cnt_tx t FULL OUTER JOIN cnt_cv v ON v.campaign_id = t.campaign_id AND v."date" = t."date"
    FULL OUTER JOIN cnt_kyc k ON k.campaign_id = coalesce(t.campaign_id, v.campaign_id) AND k."date" = coalesce(t."date", v."date")""",
                                         "cnt_tx", "cnt_cv", "cnt_kyc"))
def _daily_counts(b: Bound):
    tx, cv, ky = daily_counts(b)
    j = tx.join(cv, ["campaign_id", "date"], "full_outer").join(ky, ["campaign_id", "date"], "full_outer")
    return j.select("campaign_id", "date", *[nz(c).cast("bigint").alias(c) for c in ("txn_count", "conv_count",
                                                                                       "kyc_count")])


@query("cumulative_revenue", with_views("SELECT * FROM cum_rev", "cum_rev"))
def _cum_rev(b: Bound):
    return cum_rev(b)


@query("cumulative_profit", with_views("SELECT * FROM profit", "profit"))
def _profit(b: Bound):
    return profit(b)


@query("asof_unit_cost", with_views("""
    WITH d AS (SELECT CAST(posted_at AS DATE) AS "date", count(*) AS txn_count FROM card_transactions
               WHERE status = 'completed' GROUP BY 1),""" + _asof_rate_sql("d") + """
    SELECT d."date", d.txn_count,
           CAST(CAST(coalesce(CAST(CAST(txn_count AS DOUBLE) * CAST(rate.rate AS DOUBLE) AS DECIMAL(30,10)), 0)
                     AS DECIMAL(28,10)) AS DOUBLE) AS cogs_usd
    FROM d LEFT JOIN rate ON rate.m = strftime(d."date", '%Y-%m')""", "card_transactions", "unit_costs"))
def _asof(b: Bound):
    d = b.card_transactions.where(F.col("status") == "completed").groupBy(
        F.to_date("posted_at").alias("date")).agg(F.count(F.lit(1)).alias("txn_count"))
    return cp.asof_unit_cost(d, invoice_history(b)).withColumn("cogs_usd", dbl("cogs_usd"))


@query("running_roas", with_views("""
    WITH d AS (SELECT r.campaign_id, r."date", CAST(coalesce(s.daily_spend_usd, 0) AS DOUBLE) AS daily_spend_usd,
                      r.daily_rev_usd FROM cum_rev r LEFT JOIN spend_daily s ON s."date" = r."date"),
         c AS (SELECT *, sum(CAST(daily_rev_usd AS DECIMAL(30,10))) OVER w AS cr,
                      sum(CAST(CASE WHEN daily_spend_usd > 0 THEN daily_spend_usd END AS DECIMAL(30,10))) OVER w AS cs
               FROM d WINDOW w AS (PARTITION BY campaign_id ORDER BY "date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
         f AS (SELECT *, last_value(cs IGNORE NULLS) OVER (PARTITION BY campaign_id ORDER BY "date"
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs2 FROM c)
    SELECT campaign_id, "date", """ + _r("CAST(cr AS DOUBLE) / CAST(cs2 AS DOUBLE)", 6) + """ AS running_roas
    FROM f WHERE daily_spend_usd > 0""", "cum_rev", "spend_daily"))
def _running_roas(b: Bound):
    d = cum_rev(b).join(spend_daily(b), "date", "left").select(
        "campaign_id", "date", dbl(nz("daily_spend_usd")).alias("daily_spend_usd"), "daily_rev_usd")
    return cp.running_roas(d, keys=("campaign_id",))


@query("payback_days", with_views("""
    SELECT campaign_id, CAST(datediff('day', min("date"), min(CASE WHEN cum_profit_usd > 0 THEN "date" END)) AS BIGINT) AS payback_days
    FROM profit GROUP BY 1""", "profit"))
def _payback(b: Bound):
    return cp.payback_days(profit(b), keys=("campaign_id",))


@query("cumulative_spend", with_views("""
    SELECT s."date", CAST(s.daily_spend_usd AS DOUBLE) AS daily_spend_usd,
           CAST(sum(s.daily_spend_usd) OVER (ORDER BY s."date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cum_spend_usd,
           c.campaign_id IS NOT NULL AS is_campaign_start, coalesce(c.campaign_id, '') AS campaign_id
    FROM spend_daily s LEFT JOIN campaigns c ON c.start = s."date" """, "spend_daily", "campaigns"))
def _cum_spend(b: Bound):
    return cp.cumulative_spend(spend_daily(b), campaigns(b))


@query("campaign_totals", with_views("""
    SELECT CAST(sum(CAST(total_spend_usd AS DECIMAL(30,10))) AS DOUBLE) AS total_spend_usd,
           CAST(sum(CAST(total_revenue_usd AS DECIMAL(30,10))) AS DOUBLE) AS total_revenue_usd,
           """ + _r("CAST(sum(CAST(total_revenue_usd AS DECIMAL(30,10))) AS DOUBLE) / NULLIF(CAST(sum(CAST(total_spend_usd AS DECIMAL(30,10))) AS DOUBLE), 0.0)", 4) + """ AS roas,
           (SELECT arg_max(cum_contribution_margin_usd, ("date", campaign_id)) FROM profit) AS last_contribution_margin_usd
    FROM roi""", "roi", "profit"))
def _campaign_totals(b: Bound):
    return cp.campaign_totals(roi(b), profit(b))


@query("weighted_cac", with_views(
    "SELECT " + _r("CAST(sum(CAST(total_spend_usd AS DECIMAL(30,10))) AS DOUBLE) / "
                   "NULLIF(CAST(sum(CAST(incremental_users_est AS DECIMAL(30,10))) AS DOUBLE), 0)", 6)
    + " AS weighted_cac FROM roi", "roi"))
def _weighted_cac(b: Bound):
    return cp.weighted_cac(roi(b))


@query("campaign_cac_active", with_views("""
    SELECT c.campaign_id, CAST(coalesce(k.n, 0) AS BIGINT) AS kyc_users,
           """ + _r("CAST(CAST(CAST(c.total_spend_usd AS DOUBLE) + CAST(coalesce(k.n, 0) AS DOUBLE) * 2.07 AS DECIMAL(30,10)) AS DOUBLE)"
                    " / CAST(NULLIF(coalesce(s.transacting_users, 0), 0) AS DOUBLE)", 2) + """ AS cac_active
    FROM campaigns c LEFT JOIN crs s ON s.campaign_id = c.campaign_id
    LEFT JOIN (SELECT h.campaign_id, count(*) AS n FROM cohort h JOIN app_users u ON u.user_id = h.user_id
               WHERE u.kyc_level >= 1 GROUP BY 1) k ON k.campaign_id = c.campaign_id""",
                                         "campaigns", "crs", "cohort", "app_users"))
def _cac_active(b: Bound):
    k = cp.cohort_semi_join(b.app_users.where(F.col("kyc_level") >= 1).select("user_id"), cohort(b)).groupBy(
        "campaign_id").agg(F.count(F.lit(1)).alias("kyc_users"))
    return cp.campaign_cac_active(summary(b), campaigns(b), k)


register("all_conv_daily", """
    SELECT CAST(created_at AS DATE) AS "date",
           sum(CAST(coalesce(CAST(CAST(CAST(coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0) AS DOUBLE)
                                 / NULLIF(fx_rate, 0) AS VARCHAR) AS DECIMAL(30,10)), 0)
                   + coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0) AS DECIMAL(28,10))) AS v
    FROM conversions CROSS JOIN fx_all WHERE used = TRUE GROUP BY 1""", ["conversions", "fx_all"])


def all_conv_daily(b: Bound):
    q = scale_minor_units(b.conversion_quotes).where(F.col("used")).crossJoin(F.broadcast(fx_all(b)))
    return q.groupBy(F.to_date("created_at").alias("date")).agg(F.sum(money(
        nz(fine(safe_div(nz("fee_amount_brl") + nz("spread_revenue_brl"), F.nullif(F.col("fx_rate"), F.lit(0)))))
        + nz("fee_amount_usdc") + nz("spread_revenue_usdc"))).alias("v"))


@query("revenue_vs_spend_daily", with_views("""
    SELECT coalesce(a."date", s."date") AS "date", CAST(coalesce(a.v, 0) AS DOUBLE) AS revenue_usd,
           CAST(coalesce(s.daily_spend_usd, 0) AS DOUBLE) AS daily_spend_usd
    FROM all_conv_daily a FULL OUTER JOIN spend_daily s ON s."date" = a."date" """, "all_conv_daily", "spend_daily"))
def _rev_vs_spend(b: Bound):
    return cp.revenue_vs_spend_daily(all_conv_daily(b).withColumnRenamed("v", "revenue_usd"), spend_daily(b))


@query("cohort_vs_all_boundary", with_views("""
    WITH c AS (SELECT rev_date AS "date", sum(CAST(CAST(daily_rev_conversion_usd AS VARCHAR) AS DECIMAL(30,10))) AS v FROM daily_rev GROUP BY 1),
         a AS (SELECT a."date", CAST(greatest(coalesce(a.v, 0) - coalesce(c.v, 0), 0) AS DOUBLE) AS non_cohort_rev_usd,
                      CAST(coalesce(c.v, 0) AS DOUBLE) AS cohort_rev_usd
               FROM all_conv_daily a LEFT JOIN c ON c."date" = a."date")
    SELECT coalesce(a."date", s."date") AS "date", coalesce(non_cohort_rev_usd, 0.0) AS non_cohort_rev_usd,
           coalesce(cohort_rev_usd, 0.0) AS cohort_rev_usd, CAST(coalesce(s.daily_spend_usd, 0) AS DOUBLE) AS daily_spend_usd
    FROM a FULL OUTER JOIN spend_daily s ON s."date" = a."date" """, "daily_rev", "all_conv_daily", "spend_daily"))
def _boundary(b: Bound):
    c = daily_rev(b).groupBy(F.col("rev_date").alias("date")).agg(
        F.sum(fine("daily_rev_conversion_usd")).alias("cohort_rev_usd"))
    return cp.cohort_vs_all_boundary(all_conv_daily(b).withColumnRenamed("v", "all_rev_usd"), c, spend_daily(b))


@query("channel_comparison", with_views("""
    SELECT 'paid_campaigns' AS channel, CAST(sum(cohort_users) AS BIGINT) AS n_users,
           CAST(sum(CAST(total_revenue_usd AS DECIMAL(30,10))) AS DOUBLE) AS revenue_usd,
           CAST(sum(CAST(total_spend_usd AS DECIMAL(30,10))) AS DOUBLE) AS spend_usd,
           """ + _r("CAST(sum(CAST(total_revenue_usd AS DECIMAL(30,10))) AS DOUBLE) / NULLIF(CAST(sum(CAST(total_spend_usd AS DECIMAL(30,10))) AS DOUBLE), 0.0)", 4) + """ AS roas
    FROM roi
    UNION ALL SELECT acquisition_source, count(user_id), CAST(sum(net_revenue_usd) AS DOUBLE), NULL, NULL
    FROM master GROUP BY 1""", "roi", "master"))
def _channels(b: Bound):
    from .user_plans import master
    return cp.channel_comparison(roi(b), users.acquisition_summary(master(b)))


@query("referral_code_options", with_views("""
    SELECT DISTINCT rc.code FROM referral_codes rc JOIN user_registrations ur ON ur.attributed_referral_code_id = rc.id""",
                                           "referral_codes", "user_registrations"))
def _ref_options(b: Bound):
    return users.referral_code_options(b.user_registrations, b.referral_codes)
