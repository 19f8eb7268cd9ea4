"""The business views of sources/binding.py, re-written as DuckDB SQL.

Used only to build the independent SQL oracle; the Spark side never runs
these strings.  Keep both definitions in step.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "app_users": """
        SELECT c.c_custkey AS user_id, 'User ' || CAST(c.c_custkey AS VARCHAR) AS full_name,
               f.first_ts AS created_at, f.last_ts AS last_active_at,
               CASE WHEN c.c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'business' ELSE 'personal' END AS account_type,
               CASE WHEN c.c_acctbal >= 5000 THEN 2 WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END AS kyc_level
        FROM customer c LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_ts, MAX(o_orderdate) AS last_ts
                                   FROM orders GROUP BY o_custkey) f ON c.c_custkey = f.o_custkey""",
    "user_registrations": """
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_mktsegment) END AS source_type,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS attributed_referral_code_id
        FROM customer""",
    "referral_codes": """
        SELECT n.n_nationkey AS id, n.n_name AS code, 'Partner ' || r.r_name AS public_name,
               (n.n_regionkey + 1) * 25 AS commission_rate_basis_points,
               CASE WHEN n.n_nationkey % 2 = 0 THEN 'influencer' ELSE 'partner' END AS code_type
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "founders": """
        SELECT c_custkey AS user_id, c_custkey // 10 AS founder_number,
               CAST(c_custkey % 7 AS INTEGER) AS network_size,
               CAST(5 - c_custkey % 6 AS INTEGER) AS invites_remaining,
               CASE WHEN c_custkey % 20 = 0 THEN 'INV' || CAST(c_custkey AS VARCHAR) ELSE '' END AS invite_code
        FROM customer WHERE c_custkey % 10 = 0""",
    "user_profiles": """
        SELECT c.c_custkey AS user_id, n.n_name AS country_code,
               CASE WHEN c.c_nationkey % 2 = 0 THEN 'BRL' ELSE 'USD' END AS preferred_currency,
               c.c_acctbal > 0 AS onboarding_completed
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "cards": """
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 3 = 0 THEN 'virtual' WHEN c_custkey % 3 = 1 THEN 'platinum'
                    ELSE 'infinite' END AS variant,
               CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'blocked' END AS status
        FROM customer""",
    "conversion_quotes": """
        SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
               CASE WHEN onramp THEN 'brl_to_usdc' ELSE 'usdc_to_brl' END AS direction,
               o_orderstatus <> 'P' AS used,
               CAST(CAST(rate_bp AS DECIMAL(10,0)) * 0.01 AS DECIMAL(6,2)) AS exchange_rate,
               CAST(CAST(rate_bp AS DECIMAL(10,0)) * 0.01 AS DECIMAL(6,2)) AS effective_rate,
               CAST(1.00 AS DECIMAL(6,2)) AS spread_percentage,
               CASE WHEN onramp THEN brl END AS from_amount_brl,
               CASE WHEN onramp THEN NULL ELSE brl END AS to_amount_brl,
               CASE WHEN onramp THEN NULL ELSE price_cents * 10000 END AS from_amount_usdc,
               CASE WHEN onramp THEN price_cents * 10000 END AS to_amount_usdc,
               CASE WHEN onramp THEN (brl * 5 + 500) // 1000 ELSE CAST(0 AS BIGINT) END AS fee_amount_brl,
               CASE WHEN onramp THEN (brl + 50) // 100 END AS spread_revenue_brl,
               CASE WHEN onramp THEN CAST(0 AS BIGINT) ELSE price_cents * 50 END AS fee_amount_usdc,
               CASE WHEN onramp THEN NULL ELSE price_cents * 100 END AS spread_revenue_usdc
        FROM (SELECT *, (price_cents * rate_bp + 50) // 100 AS brl FROM (
                SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus,
                       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS price_cents,
                       500 + o_orderkey % 100 AS rate_bp, o_orderkey % 2 = 0 AS onramp
                FROM orders))""",
    "_lines": """
        SELECT l.*, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "card_transactions": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
               o_custkey AS user_id, l_shipdate AS posted_at,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_usd_cents,
               CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status,
               CASE WHEN l_returnflag = 'R' THEN 'refund' ELSE 'spend' END AS transaction_type
        FROM _lines""",
    "card_annual_fees": """
        SELECT o_custkey AS user_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS amount_usdc,
               l_shipdate AS created_at,
               CASE WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'paid' END AS status
        FROM _lines WHERE l_linenumber = 1""",
    "billing_charges": """
        SELECT o_custkey AS user_id,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) * 1000000 AS BIGINT) AS amount,
               l_shipdate AS created_at,
               CASE WHEN l_linestatus = 'F' THEN 'settled' ELSE 'pending' END AS status
        FROM _lines WHERE l_linenumber = 2""",
    "cashback_rewards": """
        SELECT o_custkey AS user_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS reward_usd_value,
               l_shipdate AS created_at,
               CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status
        FROM _lines WHERE l_linenumber % 2 = 1""",
    "revenue_share_rewards": """
        SELECT o_custkey AS source_user_id, (o_custkey // 10) * 10 AS recipient_user_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) * 0.1 AS reward_usd_value,
               l_shipdate AS created_at,
               CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status
        FROM _lines WHERE l_linenumber % 2 = 0""",
    "swap_transactions": """
        SELECT o_custkey AS user_id, l_shipdate AS "timestamp",
               CASE WHEN l_partkey % 2 = 0 THEN 'USDC' ELSE 'SOL' END AS input_mint,
               CASE WHEN l_partkey % 2 = 0 THEN 'SOL' WHEN l_partkey % 3 = 0 THEN 'USDC' ELSE 'BONK' END AS output_mint,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) * 10000 AS input_amount,
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) * 9900 AS output_amount,
               CAST(10 + l_suppkey % 40 AS INTEGER) AS platform_fee_bps
        FROM _lines WHERE l_linenumber = 3""",
    "payouts": """
        SELECT o_custkey AS user_id, l_shipdate AS created_at, CAST(l_extendedprice AS DECIMAL(18,2)) * 0.015 AS fee_usd,
               CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status
        FROM _lines WHERE l_linenumber = 4""",
    "pix_deposits": """
        SELECT o_orderkey AS id, o_custkey AS user_id,
               CASE WHEN o_orderkey % 4 = 0 THEN 'completed' WHEN o_orderkey % 4 = 1 THEN 'settled'
                    WHEN o_orderkey % 4 = 2 THEN 'confirmed' ELSE 'failed' END AS state,
               'provider_' || CAST(o_orderkey % 3 AS VARCHAR) AS provider_name,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_brl,
               o_orderdate AS created_at
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "pix_transfers": """
        SELECT o_orderkey AS id, o_custkey AS user_id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'cpf' WHEN o_orderkey % 3 = 1 THEN 'email' ELSE 'random' END AS pix_key_type,
               CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status,
               amt AS amount_brl, amt // 1000 AS fee_brl, amt - amt // 1000 AS net_amount_brl,
               o_orderdate AS executed_at, o_orderdate AS created_at
        FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amt FROM orders
              WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW'))""",
    "expense_export": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderdate AS DATE) AS "date",
               -(CAST(o_totalprice AS DECIMAL(18,2)) * 0.001) AS amount,
               CASE WHEN extract(month FROM CAST(o_orderdate AS DATE)) IN (3, 6, 9, 12) THEN 'Corner Store'
                    WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'FACEBK *ADS'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'Google Ads Svc' ELSE 'Corner Store' END AS merchantName,
               'USD' AS currency
        FROM orders""",
}

VIEWS["card_invoices"] = """
    SELECT 'INV-' || CAST(account_id AS VARCHAR) || '-' || period AS invoice_id, account_id, period,
           CAST(CAST(n_transactions AS DECIMAL(20,0)) * 0.25 + tx_volume_usd * 0.002 AS DECIMAL(20,2)) AS invoice_total_usd,
           CASE WHEN account_id % 2 = 0 THEN CAST(1000.00 AS DECIMAL(20,2)) ELSE CAST(0.00 AS DECIMAL(20,2)) END AS base_program_fee,
           tx_volume_usd, applepay_volume_usd, n_active_cards, n_transactions, n_3ds, n_infinite_txs, n_platinum_txs,
           n_applepay_txs, n_googlepay_txs, n_share_tokens, n_verify_domestic, n_verify_intl, n_chip_auth_intl, n_cross_border
    FROM (SELECT l_suppkey AS account_id, strftime(l_shipdate, '%Y-%m') AS period, count(*) AS n_transactions,
                 sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS tx_volume_usd, count(DISTINCT l_partkey) AS n_active_cards,
                 count(*) FILTER (WHERE l_returnflag = 'R') AS n_3ds, count(*) FILTER (WHERE l_linenumber = 1) AS n_infinite_txs,
                 count(*) FILTER (WHERE l_linenumber = 2) AS n_platinum_txs,
                 count(*) FILTER (WHERE l_linestatus = 'F') AS n_applepay_txs,
                 sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS applepay_volume_usd,
                 count(*) FILTER (WHERE l_linestatus = 'O') AS n_googlepay_txs,
                 count(*) FILTER (WHERE l_discount >= 0.05) AS n_share_tokens,
                 count(*) FILTER (WHERE l_tax < 0.04) AS n_verify_domestic, count(*) FILTER (WHERE l_tax >= 0.04) AS n_verify_intl,
                 count(*) FILTER (WHERE l_returnflag = 'A') AS n_chip_auth_intl, count(*) FILTER (WHERE l_quantity > 25) AS n_cross_border
          FROM lineitem GROUP BY 1, 2)"""

DEPS: dict[str, list[str]] = {
    "card_transactions": ["_lines"], "card_annual_fees": ["_lines"], "billing_charges": ["_lines"],
    "cashback_rewards": ["_lines"], "revenue_share_rewards": ["_lines"], "swap_transactions": ["_lines"],
}

# Derived views used by many oracles (defined on top of VIEWS).
VIEWS.update({
    # conversions in real units (scale_minor_units)
    "conversions": """
        SELECT id, user_id, created_at, direction, used, exchange_rate, effective_rate, spread_percentage,
               TRY_CAST(from_amount_brl AS DECIMAL(20,0)) * 0.01 AS from_amount_brl,
               TRY_CAST(to_amount_brl AS DECIMAL(20,0)) * 0.01 AS to_amount_brl,
               TRY_CAST(from_amount_usdc AS DECIMAL(20,0)) * 0.000001 AS from_amount_usdc,
               TRY_CAST(to_amount_usdc AS DECIMAL(20,0)) * 0.000001 AS to_amount_usdc,
               TRY_CAST(fee_amount_brl AS DECIMAL(20,0)) * 0.01 AS fee_amount_brl,
               TRY_CAST(spread_revenue_brl AS DECIMAL(20,0)) * 0.01 AS spread_revenue_brl,
               TRY_CAST(fee_amount_usdc AS DECIMAL(20,0)) * 0.000001 AS fee_amount_usdc,
               TRY_CAST(spread_revenue_usdc AS DECIMAL(20,0)) * 0.000001 AS spread_revenue_usdc
        FROM conversion_quotes""",
    # normalize_conversions
    "conv_norm": """
        SELECT *,
               abs(coalesce(from_amount_brl, 0)) + abs(coalesce(to_amount_brl, 0)) AS volume_brl,
               abs(coalesce(from_amount_usdc, 0)) + abs(coalesce(to_amount_usdc, 0)) AS volume_usdc,
               coalesce(fee_amount_brl, 0) + coalesce(spread_revenue_brl, 0) AS revenue_brl,
               coalesce(fee_amount_usdc, 0) + coalesce(spread_revenue_usdc, 0) AS revenue_usdc,
               CASE WHEN lower(direction) IN ('brl_to_usdc', 'buy', 'onramp') THEN 'onramp' ELSE 'offramp' END AS side
        FROM conversions""",
})
DEPS.update({"conversions": ["conversion_quotes"], "conv_norm": ["conversions"]})


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    b = body.lstrip()
    if b[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{b[14:]}"
    if b[:4].upper() == "WITH":
        return f"WITH {ctes},\n{b[4:]}"
    return f"WITH {ctes}\n{body}"


def register(name: str, sql: str, deps: list[str] | None = None) -> None:
    VIEWS[name] = sql
    DEPS[name] = list(deps or [])
