"""Queries whose results are kept up to date load by load, and as-of costs by account."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.money import dbl, rnd
from ..operators import activity, asof, cohort_store, inventory
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.binding import Bound, once
from ..sources.id_table import IdTable
from .io_plans import _SPEND_SQL, _batch
from .oracle_views import with_views
from .ramp_plans import normalized
from .registry import query
from .user_plans import daily_activity


def _r(x: str, d: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), {d}) AS DOUBLE)"


# ---------------------------------------------------------- active users
@once
def bitmaps(b: Bound):
    """Day bitmaps of all activity, loaded in two parts: the second has late rows of
    days that the first has loaded, and users that it did not know."""
    facts = daily_activity(b)
    late = (F.year("activity_date") >= 1996) | (F.col("user_id") % 11 == 0)
    first, second = facts.where(~late), facts.where(late)
    known = activity.user_numbers(first)
    numbers = activity.user_numbers(second, known)
    stored = activity.daily_bitmaps(first, known)
    return activity.merge_bitmaps(stored, activity.daily_bitmaps(second, numbers))


@query("rolling_active_users", with_views("""
    WITH days AS (SELECT unnest(generate_series(min(activity_date), max(activity_date), INTERVAL 1 DAY))::DATE AS "date" FROM daily_act),
         w AS (SELECT d."date", a.user_id, max(a.activity_date) AS last FROM days d
               JOIN daily_act a ON a.activity_date BETWEEN d."date" - 29 AND d."date" GROUP BY 1, 2)
    SELECT d."date", count(w.user_id) FILTER (last = d."date") AS dau, count(w.user_id) FILTER (last >= d."date" - 6) AS wau,
           count(w.user_id) AS mau
    FROM days d LEFT JOIN w ON w."date" = d."date" GROUP BY 1""", "daily_act"))
def _rolling(b: Bound):
    return activity.rolling_active(bitmaps(b), {"dau": 1, "wau": 7, "mau": 30})


@query("monthly_active_from_bitmaps", with_views("""
    SELECT CAST(date_trunc('month', activity_date) AS DATE) AS period, count(DISTINCT user_id) AS active_users
    FROM daily_act GROUP BY 1""", "daily_act"))
def _monthly(b: Bound):
    return activity.active_by_period(bitmaps(b), "M")


@query("returning_users_weekly", with_views("""
    WITH m AS (SELECT DISTINCT CAST(date_trunc('week', activity_date) AS DATE) AS period, user_id FROM daily_act)
    SELECT a.period, count(*) AS active_users, count(p.user_id) AS returning_users
    FROM m a LEFT JOIN m p ON p.user_id = a.user_id AND p.period = a.period - 7 GROUP BY 1""", "daily_act"))
def _returning(b: Bound):
    return activity.returning_by_period(bitmaps(b), "W")


# --------------------------------------------------------- as-of unit cost
_ACCOUNT_COSTS = """
    account_costs AS (
      SELECT account_id, CAST(strptime(period || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH AS DATE) AS valid_from,
             CAST(CAST(sum(invoice_total_usd) AS DOUBLE) / CAST(sum(n_transactions) AS DOUBLE) AS DECIMAL(30,10)) AS cost_per_txn
      FROM card_invoices GROUP BY 1, period HAVING sum(n_transactions) > 0)"""


def _account_lines(b: Bound):
    li = b.table("lineitem")
    return li.select(F.col("l_suppkey").alias("account_id"), F.col("l_shipdate").alias("posted_at"),
                     F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_usd"))


def _account_costs(b: Bound):
    # Every other month is invoiced, so rates stay valid for more than a month.
    return asof.account_unit_costs(b.card_invoices.where(F.substring("period", 6, 2).cast("int") % 2 == 1))


@query("asof_cost_by_account", with_views(f"""
    WITH {_ACCOUNT_COSTS.replace('FROM card_invoices', "FROM card_invoices WHERE CAST(substr(period, 6, 2) AS INTEGER) % 2 = 1")},
    j AS (SELECT l.l_suppkey AS account_id, CAST(l.l_shipdate AS DATE) AS "date", c.cost_per_txn
          FROM lineitem l ASOF LEFT JOIN account_costs c
          ON c.account_id = l.l_suppkey AND CAST(l.l_shipdate AS DATE) >= c.valid_from)
    SELECT account_id, "date", count(*) AS txn_count, CAST(sum(cost_per_txn) AS DOUBLE) AS cogs_usd,
           CAST(min(cost_per_txn) AS DOUBLE) AS unit_cost_usd
    FROM j GROUP BY 1, 2""", "card_invoices"))
def _asof_account(b: Bound):
    j = asof.asof_join(_account_lines(b), _account_costs(b), ["account_id"], "posted_at", "valid_from", ["cost_per_txn"])
    return j.groupBy("account_id", F.to_date("posted_at").alias("date")).agg(
        F.count(F.lit(1)).alias("txn_count"), dbl(F.sum("cost_per_txn")).alias("cogs_usd"),
        dbl(F.min("cost_per_txn")).alias("unit_cost_usd"))


# ------------------------------------------------------------ idempotent load
def _folder(b: Bound, name: str) -> str:
    return f"{ensure_checkpoint_dir(b.spark).rstrip('/')}/files-{b.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("append_pruned_load", with_views(f"""
    WITH s AS ({_SPEND_SQL})
    SELECT id, "date", CAST(amount_usd AS DOUBLE) AS amount_usd, platform FROM s""", "expense_export"))
def _pruned_load(b: Bound):
    """The spend table after three loads: two periods, and a batch that repeats all of it."""
    spend = sinks.spend_rows(b.expense_export)
    table = IdTable(b.spark, _folder(b, "spend"))
    table.load(spend.where(F.col("date") < F.lit("1995-01-01").cast("date")), tag="until 1994")
    table.load(spend.where(F.year("date").between(1994, 1996)), tag="1994 to 1996")
    table.load(spend.where(F.year("date").between(1994, 1996)), tag="1994 to 1996")
    table.load(_batch(b), tag="all")
    return table.read().withColumn("amount_usd", dbl("amount_usd"))


# --------------------------------------------------------------- inventory
@query("position_closings_by_load", with_views(f"""
    WITH RECURSIVE ev AS (
      SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS rn, CAST(created_at AS DATE) AS day,
             CASE WHEN lower(direction) IN ('usdc_to_brl', 'sell', 'offramp') THEN abs(coalesce(from_amount_usdc, 0)) ELSE 0 END AS s_in,
             CASE WHEN lower(direction) IN ('brl_to_usdc', 'buy', 'onramp') THEN abs(coalesce(to_amount_usdc, 0)) ELSE 0 END AS s_out,
             CAST(effective_rate AS DOUBLE) AS price
      FROM norm_used WHERE created_at IS NOT NULL),
    st AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS day, CAST(0 AS DECIMAL(38,6)) AS q,
             CAST(NULL AS DOUBLE) AS avg, CAST(0 AS DECIMAL(38,8)) AS cum FROM ev
      UNION ALL
      SELECT s.user_id, e.rn, e.day, s.q + e.s_in - e.s_out,
             CASE WHEN e.s_in > 0 THEN
                  CASE WHEN s.q + e.s_in > 0
                       THEN (CAST(s.q AS DOUBLE) * coalesce(s.avg, 0.0) + CAST(e.s_in AS DOUBLE) * e.price) / CAST(s.q + e.s_in AS DOUBLE)
                       ELSE e.price END
                  ELSE s.avg END,
             s.cum + CASE WHEN e.s_out > 0 AND s.avg IS NOT NULL THEN CAST((e.price - s.avg) * CAST(e.s_out AS DOUBLE) AS DECIMAL(38,8)) ELSE 0 END
      FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
    SELECT user_id, day, CAST(arg_max(q, rn) AS DOUBLE) AS position_qty_usdc,
           {_r('arg_max(CASE WHEN avg IS NULL THEN NULL ELSE avg END, CASE WHEN avg IS NULL THEN NULL ELSE rn END)', 6)} AS avg_price_brl_per_usdc,
           {_r('arg_max(cum, rn)', 2)} AS pnl_cum_brl
    FROM st WHERE rn > 0 GROUP BY 1, 2""", "norm_used"))
def _closings(b: Bound):
    """Closings per user and day after three loads; the third has late rows of all years."""
    events = normalized(b)
    late = F.col("id") % 40 == 0
    year = F.year("created_at")
    loads = [events.where((year < 1994) & ~late), events.where((year >= 1994) & (year < 1997) & ~late),
             events.where((year >= 1997) | late)]
    state = history = None
    for load in loads:
        state, _ = inventory.apply_load(state, history, load, ("user_id",))
        history = load if history is None else history.unionByName(load)
    return inventory.closing_positions(state, ("user_id",)).select(
        "user_id", "day", dbl("position_qty_usdc").alias("position_qty_usdc"),
        rnd("avg_price_brl_per_usdc", 6).alias("avg_price_brl_per_usdc"), rnd("pnl_cum_brl", 2).alias("pnl_cum_brl"))


# ------------------------------------------------------------------ cohorts
@query("cohort_cells_by_load", with_views("""
    WITH m AS (SELECT t.user_id, CAST(date_trunc('month', t.posted_at) AS DATE) AS month, sum(t.amount_usd_cents) AS cents
               FROM card_transactions t WHERE t.posted_at IS NOT NULL GROUP BY 1, 2),
         j AS (SELECT m.*, CAST(date_trunc('month', u.created_at) AS DATE) AS signup_month,
                      CAST((year(m.month) * 12 + month(m.month)) - (year(u.created_at) * 12 + month(u.created_at)) AS BIGINT) AS months_since_signup
               FROM m JOIN app_users u ON u.user_id = m.user_id WHERE u.created_at IS NOT NULL),
         c AS (SELECT signup_month, months_since_signup, count(*) AS active_users, CAST(sum(cents) AS BIGINT) AS amount_cents
               FROM j WHERE months_since_signup >= 0 GROUP BY 1, 2),
         e AS (SELECT signup_month, count(DISTINCT user_id) AS n FROM j WHERE months_since_signup >= 0 GROUP BY 1)
    SELECT c.signup_month, c.months_since_signup, c.active_users, round(CAST(c.active_users AS DOUBLE) / CAST(e.n AS DOUBLE), 6) AS retention,
           c.amount_cents, CAST(sum(c.amount_cents) OVER (PARTITION BY c.signup_month ORDER BY c.months_since_signup) AS BIGINT) AS cum_amount_cents
    FROM c JOIN e ON e.signup_month = c.signup_month""", "card_transactions", "app_users"))
def _cells(b: Bound):
    """Cohort cells of card transactions after three loads; the last has late rows."""
    tx, base = b.card_transactions, b.app_users.select("user_id", F.col("created_at").alias("signup_date"))
    year, late = F.year("posted_at"), F.col("user_id") % 13 == 0
    months = cells = None
    for part in (tx.where((year < 1994) & ~late), tx.where((year >= 1994) & (year < 1997) & ~late), tx.where((year >= 1997) | late)):
        delta = cohort_store.user_months(part, "posted_at", {"amount_cents": F.col("amount_usd_cents")})
        months, cells, _ = cohort_store.apply_months(months, cells, delta, base)
    return cohort_store.retention_report(cells, "amount_cents")
