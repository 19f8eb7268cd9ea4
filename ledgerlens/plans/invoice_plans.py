"""Invoice cost-model queries over the per-account monthly invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl
from ..operators import invoices as iv
from ..sources.binding import Bound
from ..sources.files import read_invoices
from .oracle_views import register, with_views
from .registry import query

KEYS = ("invoice_id", "account_id", "period")
SCENARIOS = (("base", None, None, None), ("no_3ds", None, None, 0),
             ("more_cards", 1000, None, None), ("high_volume", None, 50000, None))


def _r(x: str, d: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), {d}) AS DOUBLE)"


def _lines_sql() -> str:
    parts = ["SELECT invoice_id, account_id, period, 'base_program' AS line, "
             "CAST(CASE WHEN coalesce(base_program_fee, 0) > 0 THEN base_program_fee ELSE 2500.0 END AS DECIMAL(28,8)) "
             "AS amount FROM card_invoices"]
    for line, driver, key in iv.LINES:
        parts.append(f"SELECT invoice_id, account_id, period, '{line}', "
                     f"CAST(CAST({driver} AS DECIMAL(20,2)) * {iv.RATE_CARD[key]!r} AS DECIMAL(28,8)) FROM card_invoices")
    return " UNION ALL ".join(parts)


register("inv_lines", _lines_sql(), ["card_invoices"])
register("inv_totals", f"""
    SELECT i.invoice_id, i.account_id, i.period, i.n_transactions, i.invoice_total_usd AS billed_total_usd,
           t.modelled_total_usd,
           CASE WHEN i.n_transactions > 0 THEN {_r('CAST(t.modelled_total_usd AS DOUBLE) / CAST(i.n_transactions AS DOUBLE)', 6)} END
               AS cost_per_transaction
    FROM card_invoices i JOIN (SELECT invoice_id, sum(amount) AS modelled_total_usd FROM inv_lines GROUP BY 1) t
      ON t.invoice_id = i.invoice_id""", ["card_invoices", "inv_lines"])


def lines(b: Bound):
    return iv.invoice_cost_lines(b.card_invoices)


def totals(b: Bound):
    return iv.invoice_totals(b.card_invoices)


@query("invoice_cost_lines", with_views(
    f"SELECT invoice_id, account_id, period, line, {_r('amount', 2)} AS amount_usd FROM inv_lines", "inv_lines"))
def _lines(b: Bound):
    return iv.cost_lines_rounded(lines(b))


@query("cost_per_transaction", with_views(f"""
    SELECT invoice_id, account_id, period, n_transactions, CAST(billed_total_usd AS DOUBLE) AS billed_total_usd,
           {_r('modelled_total_usd', 2)} AS modelled_total_usd, cost_per_transaction FROM inv_totals""", "inv_totals"))
def _cpt(b: Bound):
    t = totals(b)
    return t.select(*KEYS, "n_transactions", dbl("billed_total_usd").alias("billed_total_usd"),
                    iv.rnd("modelled_total_usd", 2).alias("modelled_total_usd"), "cost_per_transaction")


@query("cost_contribution_pct", with_views(f"""
    SELECT invoice_id, line, {_r(f"CAST({_r('amount', 2)} * 100 AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY invoice_id) AS DOUBLE)", 2)} AS pct_of_total
    FROM inv_lines""", "inv_lines"))
def _contrib(b: Bound):
    return iv.cost_contribution_pct(lines(b))


@query("top_cost_drivers", with_views(f"""
    SELECT invoice_id, CAST(rank AS BIGINT) AS rank, line, {_r('amount', 2)} AS amount_usd,
           {_r('CAST(amount * 100 AS DOUBLE) / CAST(t AS DOUBLE)', 2)} AS share_pct
    FROM (SELECT *, sum(amount) OVER (PARTITION BY invoice_id) AS t,
                 row_number() OVER (PARTITION BY invoice_id ORDER BY amount DESC, line) AS rank FROM inv_lines)
    WHERE rank <= 5""", "inv_lines"))
def _top_drivers(b: Bound):
    return iv.top_cost_drivers(lines(b), 5)


@query("latest_invoice", with_views("""
    SELECT account_id, l.period, l.invoice_id,
           CAST(CASE WHEN coalesce(l.billed_total_usd, 0) > 0 THEN l.billed_total_usd ELSE l.modelled_total_usd END AS DOUBLE) AS total_usd
    FROM (SELECT account_id, arg_max({'period': period, 'invoice_id': invoice_id, 'billed_total_usd': billed_total_usd,
                                     'modelled_total_usd': modelled_total_usd}, period) AS l FROM inv_totals GROUP BY 1)""",
                                    "inv_totals"))
def _latest(b: Bound):
    return iv.latest_invoice(totals(b))


@query("cost_driver_delta", with_views(f"""
    WITH x AS (SELECT account_id, period, line, round(amount, 2) AS a,
                      lag(round(amount, 2)) OVER (PARTITION BY account_id, line ORDER BY period) AS prev FROM inv_lines),
         y AS (SELECT account_id, period, line, a - prev AS d, prev FROM x WHERE prev IS NOT NULL)
    SELECT account_id, period, line, CAST(d AS DOUBLE) AS delta_usd,
           CASE WHEN prev <> 0 THEN {_r('CAST(d * 100 AS DOUBLE) / CAST(prev AS DOUBLE)', 4)} ELSE 0.0 END AS delta_pct,
           CAST(row_number() OVER (PARTITION BY account_id, period ORDER BY abs(d) DESC, line) AS BIGINT) AS rank
    FROM y""", "inv_lines"))
def _driver_delta(b: Bound):
    return iv.cost_driver_delta(lines(b))


@query("invoice_reconciliation", with_views(f"""
    SELECT account_id, period, invoice_id, CAST(eff AS DOUBLE) AS billed_total_usd,
           {_r('modelled_total_usd', 2)} AS modelled_total_usd,
           CASE WHEN coalesce(billed_total_usd, 0) > 0 THEN {_r('greatest(billed_total_usd - modelled_total_usd, 0)', 2)} ELSE 0.0 END
               AS unmodelled_usd,
           {_r('CAST(sum(eff) OVER (PARTITION BY account_id) AS DOUBLE) / CAST(count(*) OVER (PARTITION BY account_id) AS DOUBLE)', 2)}
               AS avg_total_usd,
           CAST(sum(n_transactions) OVER (PARTITION BY account_id) AS BIGINT) AS total_transactions
    FROM (SELECT *, CASE WHEN coalesce(billed_total_usd, 0) > 0 THEN billed_total_usd ELSE modelled_total_usd END AS eff
          FROM inv_totals)""", "inv_totals"))
def _recon(b: Bound):
    return iv.invoice_reconciliation(totals(b))


def _sens_sql() -> str:
    per: dict[str, float] = {}
    for _, d, k in iv.LINES:
        per[d] = per.get(d, 0.0) + iv.RATE_CARD[k]
    parts = [f"SELECT invoice_id, '{d}' AS driver, CAST(CAST({d} AS DECIMAL(20,2)) * {per[d]!r} * 0.1 AS DECIMAL(30,8)) AS c "
             f"FROM card_invoices" for d in iv.DRIVERS]
    parts.append("SELECT invoice_id, 'base_program_fee', CAST(CAST(coalesce(base_program_fee, 0) AS DECIMAL(20,2)) * 0.1 "
                 "AS DECIMAL(30,8)) FROM card_invoices")
    parts.append("SELECT invoice_id, 'invoice_total_usd', CAST(0 AS DECIMAL(30,8)) FROM card_invoices")
    return " UNION ALL ".join(parts)


@query("invoice_sensitivity", with_views(f"""
    SELECT invoice_id, driver, {_r('c', 4)} AS cost_change_usd,
           CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY abs(c) DESC, driver) AS BIGINT) AS rank
    FROM ({_sens_sql()})""", "card_invoices"))
def _sensitivity(b: Bound):
    return iv.invoice_sensitivity(b.card_invoices, 0.10)


def _scenario_frame(b: Bound):
    return b.spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("scenario"), F.lit(c).cast("bigint").alias("n_active_cards"),
                 F.lit(t).cast("bigint").alias("n_transactions"), F.lit(d).cast("bigint").alias("n_3ds"))
        for s, c, t, d in SCENARIOS])))


def _scen_sql() -> str:
    vals = ", ".join("('{}', {}, {}, {})".format(s, *["NULL" if v is None else v for v in (c, t, d)])
                     for s, c, t, d in SCENARIOS)
    x = {"n_active_cards": "coalesce(s.n_active_cards, i.n_active_cards)",
         "n_transactions": "coalesce(s.n_transactions, i.n_transactions)", "n_3ds": "coalesce(s.n_3ds, i.n_3ds)"}
    terms = ["CAST(CASE WHEN coalesce(i.base_program_fee, 0) > 0 THEN i.base_program_fee ELSE 2500.0 END AS DECIMAL(28,8))"]
    for _, d, k in iv.LINES:
        terms.append(f"CAST(CAST({x.get(d, 'i.' + d)} AS DECIMAL(20,2)) * {iv.RATE_CARD[k]!r} AS DECIMAL(28,8))")
    tot = " + ".join(terms)
    return f"""
    SELECT invoice_id, scenario, n_transactions, {_r('t', 2)} AS total_usd,
           CASE WHEN n_transactions > 0 THEN {_r('CAST(t AS DOUBLE) / CAST(n_transactions AS DOUBLE)', 6)} END AS cost_per_transaction
    FROM (SELECT i.invoice_id, s.scenario, {x['n_transactions']} AS n_transactions, {tot} AS t
          FROM card_invoices i CROSS JOIN (SELECT * FROM (VALUES {vals}) v(scenario, n_active_cards, n_transactions, n_3ds)) s)"""


@query("invoice_scenarios", with_views(_scen_sql(), "card_invoices"))
def _scenarios(b: Bound):
    return iv.invoice_scenarios(b.card_invoices, _scenario_frame(b))


@query("cost_regression", with_views("""
    SELECT account_id, count(*) AS n_periods,
           round(regr_slope(CAST(modelled_total_usd AS DOUBLE), CAST(n_transactions AS DOUBLE)), 6) AS slope,
           round(regr_intercept(CAST(modelled_total_usd AS DOUBLE), CAST(n_transactions AS DOUBLE)), 4) AS intercept,
           round(regr_r2(CAST(modelled_total_usd AS DOUBLE), CAST(n_transactions AS DOUBLE)), 6) AS r_squared,
           round(regr_intercept(CAST(modelled_total_usd AS DOUBLE), CAST(n_transactions AS DOUBLE))
                 + regr_slope(CAST(modelled_total_usd AS DOUBLE), CAST(n_transactions AS DOUBLE))
                   * arg_max(CAST(n_transactions AS DOUBLE), period), 2) AS predicted_latest_usd
    FROM inv_totals GROUP BY 1""", "inv_totals"))
def _regression(b: Bound):
    return iv.cost_regression(totals(b))


_INV_OUT = ["invoice_id", "period", "invoice_total_usd", "base_program_fee"] + list(iv.DRIVERS)


def _as_out(df):
    return df.select(*[dbl(c).alias(c) if c.endswith("_usd") or c == "base_program_fee" else F.col(c)
                       for c in _INV_OUT])


@query("read_invoices", with_views("SELECT " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" if c.endswith("_usd") or c == "base_program_fee" else c for c in _INV_OUT)
                                   + " FROM card_invoices", "card_invoices"))
def _read_invoices(b: Bound):
    return _as_out(read_invoices(b.spark, b.spooled(b.card_invoices.select(*_INV_OUT), "json"), multiline=False))


@query("parse_invoice_json", with_views("SELECT " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" if c.endswith("_usd") or c == "base_program_fee" else c for c in _INV_OUT)
                                        + " FROM card_invoices", "card_invoices"))
def _parse_invoices(b: Bound):
    docs = b.card_invoices.select(F.to_json(F.struct(*_INV_OUT)).alias("json"))
    return _as_out(iv.parse_invoice_json(docs))


@query("extract_invoice_fields", with_views("SELECT " + ", ".join(
    {"tx_volume_usd": _r("round(CAST(tx_volume_usd * 0.00147 AS DECIMAL(20,2)), 2) / 0.00147", 2) + " AS tx_volume_usd",
     "applepay_volume_usd": "CAST(round(applepay_volume_usd, 0) AS DOUBLE) AS applepay_volume_usd"}.get(
        c, f"CAST({c} AS DOUBLE) AS {c}" if c.endswith("_usd") or c == "base_program_fee" else c) for c in _INV_OUT)
                                            + " FROM card_invoices", "card_invoices"))
def _extract(b: Bound):
    ex = iv.extract_invoice_fields(iv.render_invoice_text(b.card_invoices))
    return _as_out(ex.withColumn("applepay_volume_usd", F.col("applepay_volume_usd").cast("decimal(20,2)")))


@query("cost_regression_multi")
def _regression_multi(b: Bound):
    drivers = [c for c in iv.REGRESSION_FEATURES if c != "n_transactions"]
    t = totals(b).join(b.card_invoices.select("invoice_id", *drivers), "invoice_id")
    r = iv.cost_regression_multi(t)
    return r.select("account_id", "n_periods", *[F.round(c, 4).alias(c) for c in r.columns
                                                 if c not in ("account_id", "n_periods")])
