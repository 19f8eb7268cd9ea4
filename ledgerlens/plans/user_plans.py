"""User-level queries (master table and everything derived from it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl
from ..operators import ramp, users
from ..session import written_table
from ..sources.binding import AS_OF, FULL_END, FULL_START, Bound, once
from .oracle_views import register, with_views
from .ramp_plans import conversions
from .registry import query

WIN = "TRUE"  # the plans read all rows; a window is a parameter of the operators


@once
def cohort_base(b: Bound):
    return users.cohort_base(b.app_users, b.user_registrations, b.referral_codes, b.founders, b.user_profiles)


#: Streams of the master table, and the events that make a user a transacting one.
USER_STREAMS = ("card_fee_usd", "billing_usd", "cashback_usd", "revenue_share_usd", "swap_fee_usd", "payout_fee_usd",
                "n_swaps", "n_card_tx")
TRANSACTING_STREAMS = ("card_fee_usd", "billing_usd", "n_swaps", "payout_fee_usd")


def user_sums(b: Bound):
    """Sums of all other streams per user."""
    return users.ledger_sums(b.card_ledger, USER_STREAMS, ("user_id",), FULL_START, FULL_END)


@once
def user_streams(b: Bound):
    """:func:`user_sums` written once: the lines are by far the largest
    table, and master is read several times by some queries."""
    return written_table(user_sums(b), "user-streams")


def stream_frames(b: Bound, swaps_enabled: bool = False, sums=user_streams):
    """Conversions per user, and all other streams with the grand total of card
    transactions, both from ``sums``."""
    per = sums(b)
    total = per.agg(F.coalesce(F.sum("n_card_tx"), F.lit(0).cast("bigint")).alias("total_tx_count"))
    fee = F.col("swap_fee_usd") if swaps_enabled else F.lit(0).cast("decimal(28,10)")
    per = per.select("user_id", "card_fee_usd", F.col("n_card_tx").alias("user_tx_count"),
                     F.col("billing_usd").alias("card_tx_fee_usd"), "cashback_usd",
                     F.col("revenue_share_usd").alias("revenue_share_paid_usd"), fee.alias("swap_fee_usd"), "n_swaps",
                     "payout_fee_usd")
    return [users.conversion_revenue_per_user(conversions(b)),
            users.with_grand_total(per, "user_tx_count", total, "total_tx_count")]


@once
def fx_rate(b: Bound):
    from ..functions.money import scale_minor_units
    return ramp.fx_rate_median(scale_minor_units(b.conversion_quotes), FULL_START, FULL_END)


def _master_of(b: Bound, sums):
    joined = users.join_revenue_streams(cohort_base(b), stream_frames(b, sums=sums))
    return users.time_signals(users.user_profit(joined, fx_rate(b)), AS_OF)


@once
def master(b: Bound):
    """One row per user (lazy but for the sums of :func:`user_streams`, the one pass over
    the lines)."""
    return _master_of(b, user_streams)


def lazy_master(b: Bound):
    """:func:`master` for queries that read it once: nothing is written, and the lines are
    in the plan twice, for the sums and for the grand total."""
    return _master_of(b, user_sums)


# ----------------------------------------------------------------- SQL side
register("attributed", """
    SELECT r.user_id, r.source_type, r.attributed_referral_code_id AS referral_code_id, c.code AS referral_code,
           c.public_name AS referral_code_name, c.commission_rate_basis_points AS commission_rate_bps,
           c.code_type AS referral_code_type
    FROM referral_codes c RIGHT JOIN user_registrations r ON r.attributed_referral_code_id = c.id""",
         ["user_registrations", "referral_codes"])
register("cohort_base", """
    WITH who AS (SELECT user_id, founder_number, network_size AS founder_network_size, invites_remaining, invite_code,
                        TRUE AS known FROM founders)
    SELECT user_id, full_name, created_at AS signup_date, last_active_at, status, account_type,
           CASE WHEN source_type IS NOT NULL THEN source_type WHEN length(invite_code) > 0 THEN 'founder_invite'
                ELSE 'organic' END AS acquisition_source,
           referral_code_id, referral_code, referral_code_name, commission_rate_bps, referral_code_type,
           known IS NOT NULL AS is_founder, founder_number, founder_network_size, invites_remaining, invite_code,
           country_code, preferred_currency, onboarding_completed, kyc_level
    FROM app_users LEFT JOIN user_profiles USING (user_id) LEFT JOIN who USING (user_id)
    LEFT JOIN attributed USING (user_id)""", ["app_users", "attributed", "founders", "user_profiles"])

register("conv_per_user", """
    SELECT user_id,
      CAST(sum(CASE WHEN direction = 'brl_to_usdc' THEN coalesce(fee_amount_brl,0) + coalesce(spread_revenue_brl,0) ELSE 0 END) AS DECIMAL(28,10)) AS onramp_revenue_brl,
      CAST(sum(CASE WHEN direction = 'usdc_to_brl' THEN coalesce(fee_amount_brl,0) + coalesce(spread_revenue_brl,0) ELSE 0 END) AS DECIMAL(28,10)) AS offramp_revenue_brl,
      CAST(sum(CASE WHEN direction = 'brl_to_usdc' THEN coalesce(fee_amount_usdc,0) + coalesce(spread_revenue_usdc,0) ELSE 0 END) AS DECIMAL(28,10)) AS onramp_revenue_usdc,
      CAST(sum(CASE WHEN direction = 'usdc_to_brl' THEN coalesce(fee_amount_usdc,0) + coalesce(spread_revenue_usdc,0) ELSE 0 END) AS DECIMAL(28,10)) AS offramp_revenue_usdc,
      count(*) AS n_conversions,
      CAST(sum(CASE WHEN direction = 'brl_to_usdc' THEN coalesce(from_amount_brl,0) ELSE 0 END) AS DECIMAL(28,10)) AS onramp_volume_brl,
      CAST(sum(CASE WHEN direction = 'usdc_to_brl' THEN coalesce(from_amount_usdc,0) ELSE 0 END) AS DECIMAL(28,10)) AS offramp_volume_usdc
    FROM conv_used GROUP BY user_id""", ["conv_used"])
register("s_card_fees", """
    SELECT user_id, CAST(sum(amount_usdc) AS DECIMAL(28,10)) AS card_fee_usd FROM card_annual_fees
    WHERE status = 'paid' GROUP BY user_id""", ["card_annual_fees"])
register("s_card_txs", f"""
    SELECT user_id, count(*) AS user_tx_count, CAST(sum(count(*)) OVER () AS BIGINT) AS total_tx_count
    FROM card_transactions WHERE status = 'completed' AND {WIN.format(c='posted_at')} GROUP BY user_id""",
         ["card_transactions"])
register("s_billing", f"""
    SELECT user_id, CAST(sum(CAST(amount AS DECIMAL(20,0)) * 0.000001) AS DECIMAL(28,10)) AS card_tx_fee_usd
    FROM billing_charges WHERE status = 'settled' AND {WIN.format(c='created_at')} GROUP BY user_id""",
         ["billing_charges"])
register("s_cashback", f"""
    SELECT user_id, CAST(sum(reward_usd_value) AS DECIMAL(28,10)) AS cashback_usd FROM cashback_rewards
    WHERE status = 'completed' AND {WIN.format(c='created_at')} GROUP BY user_id""", ["cashback_rewards"])
register("s_revshare", f"""
    SELECT source_user_id AS user_id, CAST(sum(reward_usd_value) AS DECIMAL(28,10)) AS revenue_share_paid_usd
    FROM revenue_share_rewards WHERE status = 'completed' AND {WIN.format(c='created_at')}
    GROUP BY source_user_id""", ["revenue_share_rewards"])
register("s_payouts", f"""
    SELECT user_id, CAST(sum(fee_usd) AS DECIMAL(28,10)) AS payout_fee_usd FROM payouts
    WHERE status = 'completed' AND {WIN.format(c='created_at')} GROUP BY user_id""", ["payouts"])
register("s_swaps", f"""
    SELECT user_id, CAST(sum(0) AS DECIMAL(28,10)) AS swap_fee_usd, count(*) AS n_swaps FROM swap_transactions
    WHERE {WIN.format(c='"timestamp"')} GROUP BY user_id""", ["swap_transactions"])
register("fx", f"""
    SELECT coalesce(round(median(CAST(effective_rate AS DOUBLE)), 6), 5.8) AS fx_rate FROM conversions
    WHERE used = TRUE AND direction = 'brl_to_usdc' AND {WIN.format(c='created_at')}""", ["conversions"])
register("joined", """
    SELECT b.*,
      coalesce(c.onramp_revenue_brl, 0) AS onramp_revenue_brl, coalesce(c.offramp_revenue_brl, 0) AS offramp_revenue_brl,
      coalesce(c.onramp_revenue_usdc, 0) AS onramp_revenue_usdc, coalesce(c.offramp_revenue_usdc, 0) AS offramp_revenue_usdc,
      coalesce(c.n_conversions, 0) AS n_conversions, coalesce(c.onramp_volume_brl, 0) AS onramp_volume_brl,
      coalesce(c.offramp_volume_usdc, 0) AS offramp_volume_usdc, coalesce(cf.card_fee_usd, 0) AS card_fee_usd,
      coalesce(ct.user_tx_count, 0) AS user_tx_count, coalesce(ct.total_tx_count, 0) AS total_tx_count,
      coalesce(bc.card_tx_fee_usd, 0) AS card_tx_fee_usd, coalesce(cb.cashback_usd, 0) AS cashback_usd,
      coalesce(rs.revenue_share_paid_usd, 0) AS revenue_share_paid_usd,
      coalesce(sw.swap_fee_usd, 0) AS swap_fee_usd, coalesce(sw.n_swaps, 0) AS n_swaps,
      coalesce(po.payout_fee_usd, 0) AS payout_fee_usd
    FROM cohort_base b
    LEFT JOIN conv_per_user c ON c.user_id = b.user_id LEFT JOIN s_card_fees cf ON cf.user_id = b.user_id
    LEFT JOIN s_card_txs ct ON ct.user_id = b.user_id LEFT JOIN s_billing bc ON bc.user_id = b.user_id
    LEFT JOIN s_cashback cb ON cb.user_id = b.user_id LEFT JOIN s_revshare rs ON rs.user_id = b.user_id
    LEFT JOIN s_swaps sw ON sw.user_id = b.user_id LEFT JOIN s_payouts po ON po.user_id = b.user_id""",
         ["cohort_base", "conv_per_user", "s_card_fees", "s_card_txs", "s_billing", "s_cashback", "s_revshare",
          "s_swaps", "s_payouts"])
register("master", f"""
    SELECT *, on_usd + off_usd + card_fee_usd + card_tx_fee_usd + swap_fee_usd - cashback_usd
              - revenue_share_paid_usd - card_cost_allocated_usd - kyc_cost_usd AS net_revenue_usd
    FROM (SELECT j.*,
            CASE WHEN coalesce(total_tx_count, 0) > 0
                 THEN CAST(6693.58 * CAST(user_tx_count AS DOUBLE) / CAST(total_tx_count AS DOUBLE) AS DECIMAL(30,10))
                 ELSE CAST(0 AS DECIMAL(30,10)) END AS card_cost_allocated_usd,
            CAST(CAST(onramp_revenue_brl AS DOUBLE) / fx.fx_rate AS DECIMAL(30,10)) + onramp_revenue_usdc AS on_usd,
            CAST(CAST(offramp_revenue_brl AS DOUBLE) / fx.fx_rate AS DECIMAL(30,10)) + offramp_revenue_usdc AS off_usd,
            CAST(2.07 AS DECIMAL(10,2)) AS kyc_cost_usd,
            CAST(greatest(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(last_active_at, TIMESTAMP '1970-01-01'))) / 86400000000), 0) AS BIGINT) AS days_since_last_active,
            greatest(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(signup_date)) / 86400000000) / 30.44, 0.0) AS tenure_months
          FROM joined j CROSS JOIN fx)""", ["joined", "fx"])


def _mq(body: str, *extra: str) -> str:
    return with_views(body, "master", *extra)


# ----------------------------------------------------------------- joins
@query("cohort_base", with_views("SELECT * FROM cohort_base", "cohort_base"))
def _cohort_base(b: Bound):
    return cohort_base(b)


@query("user_attribution", with_views("""
    SELECT u.user_id, coalesce(ur.source_type, CASE WHEN f.invite_code IS NOT NULL AND f.invite_code <> ''
                                                  THEN 'founder_invite' ELSE 'unknown' END) AS acquisition_source,
           f.user_id IS NOT NULL AS is_founder
    FROM app_users u LEFT JOIN user_registrations ur ON ur.user_id = u.user_id
    LEFT JOIN founders f ON f.user_id = u.user_id""", "app_users", "user_registrations", "founders"))
def _attribution(b: Bound):
    return users.user_attribution(b.app_users, b.user_registrations, b.founders)


_STREAM_COLS = ["onramp_revenue_brl", "offramp_revenue_brl", "onramp_revenue_usdc", "offramp_revenue_usdc",
                "onramp_volume_brl", "offramp_volume_usdc", "card_fee_usd", "card_tx_fee_usd", "cashback_usd",
                "revenue_share_paid_usd", "swap_fee_usd"]


@query("join_revenue_streams", with_views(
    "SELECT user_id, acquisition_source, n_conversions, user_tx_count, total_tx_count, n_swaps, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _STREAM_COLS) + " FROM joined", "joined"))
def _join_streams(b: Bound):
    j = users.join_revenue_streams(cohort_base(b), stream_frames(b))
    return j.select("user_id", "acquisition_source", "n_conversions", "user_tx_count", "total_tx_count",
                    "n_swaps", *[dbl(c).alias(c) for c in _STREAM_COLS])


@query("conversion_revenue_per_user", with_views(
    "SELECT user_id, n_conversions, " + ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}" for c in _STREAM_COLS[:6]) + " FROM conv_per_user", "conv_per_user"))
def _conv_per_user(b: Bound):
    c = users.conversion_revenue_per_user(conversions(b))
    return c.select("user_id", "n_conversions", *[dbl(x).alias(x) for x in _STREAM_COLS[:6]])


@query("conversion_monthly", with_views("""
    SELECT user_id, CAST(date_trunc('month', created_at) AS DATE) AS month,
           CAST(sum(coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0)) AS DOUBLE) AS conversion_revenue_brl,
           CAST(sum(coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0)) AS DOUBLE) AS conversion_revenue_usdc
    FROM conv_used GROUP BY 1, 2""", "conv_used"))
def _conv_monthly(b: Bound):
    c = users.conversion_monthly(conversions(b))
    return c.select("user_id", "month", dbl("conversion_revenue_brl").alias("conversion_revenue_brl"),
                    dbl("conversion_revenue_usdc").alias("conversion_revenue_usdc"))


@query("per_user_sums", with_views("""
    SELECT user_id, 'card_fee_usd' AS stream, CAST(card_fee_usd AS DOUBLE) AS value FROM s_card_fees
    UNION ALL SELECT user_id, 'card_tx_fee_usd', CAST(card_tx_fee_usd AS DOUBLE) FROM s_billing
    UNION ALL SELECT user_id, 'cashback_usd', CAST(cashback_usd AS DOUBLE) FROM s_cashback
    UNION ALL SELECT user_id, 'revenue_share_paid_usd', CAST(revenue_share_paid_usd AS DOUBLE) FROM s_revshare""",
                                  "s_card_fees", "s_billing", "s_cashback", "s_revshare"))
def _per_user_sums(b: Bound):
    names = {"card_fee_usd": "card_fee_usd", "card_tx_fee_usd": "billing_usd", "cashback_usd": "cashback_usd",
             "revenue_share_paid_usd": "revenue_share_usd"}
    sums = users.ledger_sums(b.card_ledger, list(names.values()), ("user_id",), FULL_START, FULL_END)
    return users.ledger_long(sums.select("user_id", *[F.col(v).alias(k) for k, v in names.items()]), list(names),
                             ["user_id"])


register("month_streams", f"""
    SELECT user_id, CAST(date_trunc('month', created_at) AS DATE) AS month, 'card_fee_usd' AS stream,
           CAST(sum(amount_usdc) AS DOUBLE) AS value
    FROM card_annual_fees WHERE status = 'paid' AND {WIN.format(c='created_at')} GROUP BY 1, 2
    UNION ALL SELECT user_id, CAST(date_trunc('month', created_at) AS DATE), 'billing_usd',
           CAST(sum(CAST(amount AS DECIMAL(20,0)) * 0.000001) AS DOUBLE)
    FROM billing_charges WHERE status = 'settled' AND {WIN.format(c='created_at')} GROUP BY 1, 2
    UNION ALL SELECT user_id, CAST(date_trunc('month', created_at) AS DATE), 'cashback_usd', CAST(sum(reward_usd_value) AS DOUBLE)
    FROM cashback_rewards WHERE status = 'completed' AND {WIN.format(c='created_at')} GROUP BY 1, 2
    UNION ALL SELECT source_user_id, CAST(date_trunc('month', created_at) AS DATE), 'revenue_share_usd', CAST(sum(reward_usd_value) AS DOUBLE)
    FROM revenue_share_rewards WHERE status = 'completed' AND {WIN.format(c='created_at')} GROUP BY 1, 2
    UNION ALL SELECT user_id, CAST(date_trunc('month', posted_at) AS DATE), 'n_card_txns', CAST(count(*) AS DOUBLE)
    FROM card_transactions WHERE status = 'completed' AND transaction_type = 'spend' AND posted_at IS NOT NULL
      AND {WIN.format(c='posted_at')} GROUP BY 1, 2
    UNION ALL SELECT user_id, CAST(date_trunc('month', "timestamp") AS DATE), 'swap_fee_usd',
           CAST(sum(CASE WHEN input_mint = 'USDC' THEN CAST(input_amount AS DECIMAL(20,0)) * CAST(platform_fee_bps AS DECIMAL(5,0)) * 0.0000000001
                         WHEN output_mint = 'USDC' THEN CAST(output_amount AS DECIMAL(20,0)) * CAST(platform_fee_bps AS DECIMAL(5,0)) * 0.0000000001
                         ELSE 0 END) AS DOUBLE)
    FROM swap_transactions WHERE {WIN.format(c='"timestamp"')} GROUP BY 1, 2""",
         ["card_annual_fees", "billing_charges", "cashback_rewards", "revenue_share_rewards", "card_transactions",
          "swap_transactions"])


MONTH_STREAMS = ("card_fee_usd", "billing_usd", "cashback_usd", "revenue_share_usd", "n_card_spend", "swap_fee_usd",
                 "n_swaps")


def month_streams(b: Bound, names=MONTH_STREAMS):
    """All streams per (user, month) in one pass over the ledger."""
    return users.ledger_sums(b.card_ledger, names, ("user_id", users.ledger_month()), FULL_START, FULL_END)


@query("per_user_month_sums", with_views("SELECT * FROM month_streams", "month_streams"))
def _per_user_month(b: Bound):
    names = {"card_fee_usd": "card_fee_usd", "billing_usd": "billing_usd", "cashback_usd": "cashback_usd",
             "revenue_share_usd": "revenue_share_usd", "n_card_txns": "n_card_spend", "swap_fee_usd": "swap_fee_usd"}
    sums = month_streams(b).select("user_id", "month", *[F.col(v).alias(k) for k, v in names.items()])
    return users.ledger_long(sums, list(names), ["user_id", "month"])


@query("swap_fee", with_views(f"""
    SELECT user_id, CAST(sum(CASE WHEN input_mint = 'USDC' THEN CAST(input_amount AS DECIMAL(20,0)) * CAST(platform_fee_bps AS DECIMAL(5,0)) * 0.0000000001
                         WHEN output_mint = 'USDC' THEN CAST(output_amount AS DECIMAL(20,0)) * CAST(platform_fee_bps AS DECIMAL(5,0)) * 0.0000000001
                         ELSE 0 END) AS DOUBLE) AS swap_fee_usd, count(*) AS n_swaps
    FROM swap_transactions WHERE {WIN.format(c='"timestamp"')} GROUP BY user_id""", "swap_transactions"))
def _swap_fee(b: Bound):
    s = users.swaps_per_user(ramp.scan_window(b.swap_transactions, "timestamp", FULL_START, FULL_END),
                             enabled=True)
    return s.select("user_id", dbl("swap_fee_usd").alias("swap_fee_usd"), "n_swaps")


@query("card_tx_share", with_views("SELECT * FROM s_card_txs", "s_card_txs"))
def _card_tx_share(b: Bound):
    return users.card_tx_share(b.card_transactions, "completed", FULL_START, FULL_END)


@query("prorata_allocation", _mq(
    "SELECT user_id, user_tx_count, total_tx_count, CAST(card_cost_allocated_usd AS DOUBLE) AS card_cost_allocated_usd"
    " FROM master"))
def _prorata(b: Bound):
    return master(b).select("user_id", "user_tx_count", "total_tx_count",
                            dbl("card_cost_allocated_usd").alias("card_cost_allocated_usd"))


_MASTER_OUT = ["onramp_revenue_usd", "offramp_revenue_usd", "card_fee_usd", "card_tx_fee_usd", "swap_fee_usd",
               "cashback_usd", "revenue_share_paid_usd", "card_cost_allocated_usd", "kyc_cost_usd",
               "net_revenue_usd"]


@query("user_profit", _mq(
    "SELECT user_id, acquisition_source, is_founder, n_conversions, "
    + ", ".join(f"CAST({'on_usd' if c == 'onramp_revenue_usd' else 'off_usd' if c == 'offramp_revenue_usd' else c}"
                f" AS DOUBLE) AS {c}" for c in _MASTER_OUT) + " FROM master"))
def _user_profit(b: Bound):
    m = lazy_master(b)
    return m.select("user_id", "acquisition_source", "is_founder", "n_conversions",
                    *[dbl(c).alias(c) for c in _MASTER_OUT])


@query("time_signals", _mq("SELECT user_id, days_since_last_active, round(tenure_months, 6) AS tenure_months "
                           "FROM master"))
def _time_signals(b: Bound):
    return master(b).select("user_id", "days_since_last_active", F.round("tenure_months", 6).alias("tenure_months"))


@query("mask_user_id", with_views("SELECT user_id, substring(CAST(user_id AS VARCHAR), 1, 8) || '...' AS masked "
                                  "FROM app_users", "app_users"))
def _mask(b: Bound):
    return b.app_users.select("user_id", users.mask_user_id("user_id").alias("masked"))


@query("acquisition_source", with_views("SELECT user_id, acquisition_source FROM cohort_base", "cohort_base"))
def _acq_source(b: Bound):
    return cohort_base(b).select("user_id", "acquisition_source")


# ------------------------------------------------------------ user reports
@query("revenue_leaderboard", _mq("""
    SELECT substring(CAST(user_id AS VARCHAR), 1, 8) || '...' AS user_id, full_name, acquisition_source, referral_code,
           CAST(net_revenue_usd AS DOUBLE) AS net_revenue_usd, CAST(on_usd AS DOUBLE) AS onramp_revenue_usd,
           CAST(off_usd AS DOUBLE) AS offramp_revenue_usd, CAST(card_fee_usd AS DOUBLE) AS card_fee_usd,
           CAST(cashback_usd AS DOUBLE) AS cashback_usd, CAST(card_cost_allocated_usd AS DOUBLE) AS card_cost_allocated_usd,
           n_conversions
    FROM master ORDER BY net_revenue_usd DESC, master.user_id LIMIT 50"""))
def _leaderboard(b: Bound):
    return users.revenue_leaderboard(master(b), 50)


register("adoption", """
    SELECT user_id, n_conversions > 0 AS has_conversion, onramp_volume_brl > 0 AS has_onramp,
           offramp_volume_usdc > 0 AS has_offramp, (card_fee_usd > 0 OR card_tx_fee_usd > 0) AS has_card,
           n_swaps > 0 AS has_swap, payout_fee_usd > 0 AS has_crossborder,
           CAST(n_conversions > 0 AS BIGINT) + CAST(card_fee_usd > 0 OR card_tx_fee_usd > 0 AS BIGINT)
           + CAST(n_swaps > 0 AS BIGINT) + CAST(payout_fee_usd > 0 AS BIGINT) AS n_products
    FROM master""", ["master"])


@query("product_adoption", with_views(
    "SELECT substring(CAST(user_id AS VARCHAR), 1, 8) || '...' AS user_id, has_conversion, has_onramp, has_offramp,"
    " has_card, has_swap, has_crossborder, n_products FROM adoption", "adoption"))
def _adoption(b: Bound):
    return users.product_adoption(master(b))


@query("product_adoption_rates", with_views("""
    SELECT product, round(pct, 6) AS pct_users FROM (
      SELECT 'has_conversion' AS product, avg(CAST(has_conversion AS DOUBLE)) AS pct FROM adoption
      UNION ALL SELECT 'has_onramp', avg(CAST(has_onramp AS DOUBLE)) FROM adoption
      UNION ALL SELECT 'has_offramp', avg(CAST(has_offramp AS DOUBLE)) FROM adoption
      UNION ALL SELECT 'has_card', avg(CAST(has_card AS DOUBLE)) FROM adoption
      UNION ALL SELECT 'has_swap', avg(CAST(has_swap AS DOUBLE)) FROM adoption
      UNION ALL SELECT 'has_crossborder', avg(CAST(has_crossborder AS DOUBLE)) FROM adoption)""", "adoption"))
def _adoption_rates(b: Bound):
    return users.product_adoption_rates(users.product_adoption(master(b)))


@query("n_products_distribution", with_views(
    "SELECT n_products, count(*) AS n_users FROM adoption GROUP BY 1", "adoption"))
def _nprod(b: Bound):
    return users.n_products_distribution(users.product_adoption(master(b)))


register("rev_gen_users", f"""
    SELECT CAST(user_id AS VARCHAR) AS user_id FROM conversion_quotes WHERE used = TRUE
    UNION SELECT CAST(user_id AS VARCHAR) FROM card_annual_fees WHERE status = 'paid'
    UNION SELECT CAST(user_id AS VARCHAR) FROM billing_charges WHERE status = 'settled'
    UNION SELECT CAST(user_id AS VARCHAR) FROM swap_transactions
    UNION SELECT CAST(user_id AS VARCHAR) FROM cashback_rewards WHERE status = 'completed'
    UNION SELECT CAST(user_id AS VARCHAR) FROM pix_transfers WHERE status = 'completed'
    UNION SELECT CAST(recipient_user_id AS VARCHAR) FROM revenue_share_rewards WHERE status = 'completed'
    UNION SELECT CAST(user_id AS VARCHAR) FROM payouts WHERE status = 'completed'""",
         ["conversion_quotes", "card_annual_fees", "billing_charges", "swap_transactions", "cashback_rewards",
          "pix_transfers", "revenue_share_rewards", "payouts"])


def transacting_sources(b: Bound):
    """The one list of sources that make a user a transacting one: used
    conversions, paid card fees, settled billing, swaps and completed payouts."""
    return [b.conversion_quotes.where(F.col("used")).select("user_id"),
            users.ledger_rows(b.card_ledger, TRANSACTING_STREAMS).select("user_id")]


def revenue_generating_sources(b: Bound):
    """The transacting sources, cashback, transfers and recipients of revenue share."""
    st = F.col("status")
    return [b.conversion_quotes.where(F.col("used")).select("user_id"),
            users.ledger_rows(b.card_ledger, (*TRANSACTING_STREAMS, "cashback_usd")).select("user_id"),
            b.pix_transfers.where(st == "completed"),
            b.revenue_share_rewards.where(st == "completed").select(F.col("recipient_user_id").alias("user_id"))]


@query("revenue_generating_count", with_views(
    "SELECT count(DISTINCT user_id) AS revenue_generating_count FROM rev_gen_users", "rev_gen_users"))
def _rev_gen(b: Bound):
    return users.revenue_generating_count(revenue_generating_sources(b))


@query("activation_funnel", with_views("""
    WITH t AS (SELECT count(*) AS total_users, count(*) FILTER (WHERE coalesce(kyc_level, 0) >= 1) AS kyc_done,
                      (SELECT count(DISTINCT user_id) FROM rev_gen_users) AS active_users FROM master),
         s AS (SELECT 1 AS step, 'total_users' AS stage, total_users AS n, NULL AS prev, total_users AS tot FROM t
               UNION ALL SELECT 2, 'kyc_done', kyc_done, total_users, total_users FROM t
               UNION ALL SELECT 3, 'active_users', active_users, kyc_done, total_users FROM t)
    SELECT CAST(step AS BIGINT) AS step, stage, CAST(n AS BIGINT) AS n,
           round(CAST(n AS DOUBLE) / NULLIF(prev, 0), 6) AS step_rate,
           round(CAST(n AS DOUBLE) / NULLIF(tot, 0), 6) AS overall_rate FROM s""", "master", "rev_gen_users"))
def _funnel(b: Bound):
    return users.activation_funnel(master(b), users.revenue_generating_count(revenue_generating_sources(b)))


@query("acquisition_summary", _mq("""
    SELECT acquisition_source, count(user_id) AS n_users, count(*) FILTER (WHERE net_revenue_usd > 0) AS n_transacting,
           round(CAST(sum(net_revenue_usd) AS DOUBLE) / count(net_revenue_usd), 6) AS avg_net_revenue_usd,
           round(median(CAST(net_revenue_usd AS DOUBLE)), 6) AS median_net_revenue_usd,
           CAST(sum(net_revenue_usd) AS DOUBLE) AS total_net_revenue_usd,
           round(CAST(count(*) FILTER (WHERE net_revenue_usd > 0) AS DOUBLE) / count(*), 6) AS conversion_rate
    FROM master GROUP BY 1"""))
def _acq_summary(b: Bound):
    return users.acquisition_summary(master(b))


@query("referral_code_summary", _mq("""
    SELECT referral_code, referral_code_name, commission_rate_bps, n_users, round(a, 6) AS avg_net_revenue_usd,
           round(greatest(a * CAST(commission_rate_bps AS DOUBLE) / 10000.0, 0.0), 6) AS avg_commission_cost_usd,
           round(a - greatest(a * CAST(commission_rate_bps AS DOUBLE) / 10000.0, 0.0), 6) AS net_arpu_after_commission
    FROM (SELECT referral_code, referral_code_name, commission_rate_bps, count(user_id) AS n_users,
                 CAST(sum(net_revenue_usd) / count(net_revenue_usd) AS DOUBLE) AS a
          FROM master WHERE referral_code IS NOT NULL AND referral_code <> '' GROUP BY 1, 2, 3)"""))
def _ref_summary(b: Bound):
    return users.referral_code_summary(master(b))


@query("founders_report", _mq("""
    SELECT m.user_id, full_name, referral_code, founder_number, founder_network_size, invites_remaining,
           CAST(net_revenue_usd AS DOUBLE) AS net_revenue_usd, CAST(coalesce(a.n_products, 0) AS BIGINT) AS n_products,
           round(CASE WHEN coalesce(founder_network_size, 0) > 0
                      THEN CAST(net_revenue_usd AS DOUBLE) / CAST(founder_network_size AS DOUBLE) END, 6)
               AS revenue_per_network_member
    FROM master m LEFT JOIN adoption a ON a.user_id = m.user_id WHERE is_founder""", "adoption"))
def _founders(b: Bound):
    return users.founders_report(lazy_master(b))


@query("underused_invites", _mq("""
    SELECT user_id, founder_number, invites_remaining, founder_network_size FROM master
    WHERE is_founder AND invites_remaining > 0 ORDER BY invites_remaining DESC, user_id LIMIT 20"""))
def _underused(b: Bound):
    return users.underused_invites(master(b), 20)


@query("at_risk_users", _mq("""
    SELECT user_id, full_name, referral_code, acquisition_source, days_since_last_active,
           CAST(net_revenue_usd AS DOUBLE) AS net_revenue_usd, CAST(on_usd AS DOUBLE) AS onramp_revenue_usd,
           n_conversions, round(tenure_months, 6) AS tenure_months
    FROM master WHERE days_since_last_active BETWEEN 30 AND 90 AND CAST(net_revenue_usd AS DOUBLE) >= 0.0"""))
def _at_risk(b: Bound):
    return users.at_risk_users(master(b))


@query("revenue_totals", _mq("""
    SELECT CAST(coalesce(sum(card_fee_usd), 0) AS DOUBLE) AS card_fee_usd,
           CAST(coalesce(sum(card_tx_fee_usd), 0) AS DOUBLE) AS card_tx_fee_usd,
           CAST(coalesce(sum(net_revenue_usd), 0) AS DOUBLE) AS net_revenue_usd FROM master"""))
def _rev_totals(b: Bound):
    return users.revenue_totals(master(b))


@query("daily_signups", with_views(f"""
    SELECT CAST(created_at AS DATE) AS signup_date, count(*) AS new_signups FROM app_users
    WHERE created_at IS NOT NULL AND {WIN.format(c='created_at')} GROUP BY 1""", "app_users"))
def _daily_signups(b: Bound):
    return users.daily_signups(b.app_users, "created_at", FULL_START, FULL_END)


@query("activity_kpis", with_views(f"""
    SELECT count(*) FILTER (WHERE last_active_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS dau,
           count(*) FILTER (WHERE last_active_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS wau,
           count(*) FILTER (WHERE last_active_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS mau
    FROM app_users WHERE status <> 'suspended' AND last_active_at < TIMESTAMP '{AS_OF}'""", "app_users"))
def _activity_kpis(b: Bound):
    return users.activity_kpis(b.app_users, AS_OF)


@query("signups_24h", with_views(f"""
    SELECT count(*) AS new_signups_24h FROM app_users
    WHERE created_at >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 24 HOUR
      AND created_at < TIMESTAMP '1998-06-01 00:00:00'""", "app_users"))
def _signups_24h(b: Bound):
    return users.signups_24h(b.app_users, "1998-06-01 00:00:00")


@query("active_cards_summary", with_views("""
    SELECT coalesce(variant, 'total') AS variant, count(*) AS n_cards FROM cards WHERE status = 'active'
    GROUP BY ROLLUP (variant)""", "cards"))
def _cards_summary(b: Bound):
    return users.active_cards_summary(b.cards)


@query("cumulative_profit_by_source", _mq("""
    SELECT signup_date, acquisition_source, CAST(daily AS DOUBLE) AS daily_net_revenue_usd,
           CAST(sum(daily) OVER (PARTITION BY acquisition_source ORDER BY signup_date
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative_net_revenue_usd
    FROM (SELECT CAST(signup_date AS DATE) AS signup_date, acquisition_source, sum(net_revenue_usd) AS daily
          FROM master GROUP BY 1, 2)"""))
def _cum_by_source(b: Bound):
    return users.cumulative_profit_by_source(master(b))


# ------------------------------------------------------------------ set ops
@query("transacting_users", with_views("""
    SELECT DISTINCT user_id FROM (
      SELECT CAST(user_id AS VARCHAR) AS user_id FROM conv_used
      UNION ALL SELECT CAST(user_id AS VARCHAR) FROM card_annual_fees WHERE status = 'paid'
      UNION ALL SELECT CAST(user_id AS VARCHAR) FROM billing_charges WHERE status = 'settled'
      UNION ALL SELECT CAST(user_id AS VARCHAR) FROM swap_transactions
      UNION ALL SELECT CAST(user_id AS VARCHAR) FROM payouts WHERE status = 'completed')""",
                                      "conv_used", "card_annual_fees", "billing_charges", "swap_transactions",
                                      "payouts"))
def _transacting(b: Bound):
    return users.distinct_users(transacting_sources(b))


register("daily_act", f"""
    SELECT DISTINCT user_id, CAST(activity_ts AS DATE) AS activity_date FROM (
      SELECT user_id, created_at AS activity_ts FROM conversion_quotes WHERE used = TRUE AND {WIN.format(c='created_at')}
      UNION ALL SELECT user_id, posted_at FROM card_transactions WHERE status = 'completed' AND transaction_type = 'spend'
        AND posted_at IS NOT NULL AND {WIN.format(c='posted_at')})""", ["conversion_quotes", "card_transactions"])


def daily_activity(b: Bound):
    conv = ramp.scan_window(b.conversion_quotes, "created_at", FULL_START, FULL_END, F.col("used"))
    cards = ramp.scan_window(b.card_transactions, "posted_at", FULL_START, FULL_END,
                             (F.col("status") == "completed") & (F.col("transaction_type") == "spend")
                             & F.col("posted_at").isNotNull())
    return users.daily_activity([conv.select("user_id", F.col("created_at").alias("activity_ts")),
                                 cards.select("user_id", F.col("posted_at").alias("activity_ts"))])


@query("daily_activity", with_views("SELECT * FROM daily_act", "daily_act"))
def _daily_activity(b: Bound):
    return daily_activity(b)
