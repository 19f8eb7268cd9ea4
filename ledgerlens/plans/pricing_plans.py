"""Card pricing queries over the completed card spend."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import dbl
from ..operators import pricing as pr
from ..sources.binding import Bound
from .oracle_views import register, with_views
from .ramp_plans import card_spend
from .registry import query

COST = pr.INVOICE_COST_DEFAULT
SCENARIOS = (("baseline", 1.0, 1.0), ("growth", 2.0, 1.5), ("scale", 5.0, 2.0), ("aggressive", 10.0, 3.0))
GAPS = (5.0, 10.0, 15.0, 20.0, 30.0, 50.0)
FLATS = (0.10, 0.20, 0.30, 0.40, 0.50, 0.75, 1.00)
# The default tier tables (flat fee per tx; percent of amount).
FLAT_TIERS = (("F1", 0.0, 10.0, 0.25), ("F2", 10.0, 20.0, 0.50), ("F3", 20.0, None, 1.00))
PCT_TIERS = (("P1", 0.0, 8.0, 2.00), ("P2", 8.0, 16.0, 1.89), ("P3", 16.0, 24.0, 1.78), ("P4", 24.0, 32.0, 1.67),
             ("P5", 32.0, 40.0, 1.56), ("P6", 40.0, 48.0, 1.44), ("P7", 48.0, 56.0, 1.33), ("P8", 56.0, 64.0, 1.22),
             ("P9", 64.0, 72.0, 1.11), ("P10", 72.0, None, 1.00))


def _tiers(b: Bound, rows):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("tier", T.StringType()), T.StructField("lo", T.DoubleType()),
                           T.StructField("hi", T.DoubleType()), T.StructField("fee", T.DoubleType())])
    return b.spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("tier"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"),
                 F.lit(fee).cast("double").alias("fee")) for t, lo, hi, fee in rows])))


def _values(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(cols)}))"


def _r(x: str, d: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), {d}) AS DOUBLE)"


BIN_SQL = "(" + " + ".join(f"CAST(amount_usd >= {e} AS INTEGER)" for e in pr.BIN_EDGES[1:]) + ")"
BINS = _values([(i, pr.BIN_LABELS[i], pr.BIN_MIDPOINTS[i]) for i in range(7)], ["bin", "label", "midpoint"])
MODELS_SQL = {
    pr.MODEL_A: "round(amount_usd * 0.01, 4)",
    pr.MODEL_B: "CAST(0.99 AS DECIMAL(10,4))",
    pr.MODEL_C: "CASE WHEN amount_usd < 30.0 THEN 0.30 ELSE round(amount_usd * 0.01, 4) END",
    pr.MODEL_D: "round(least(amount_usd * 0.01, 5.00), 4)",
}
register("fees_long", " UNION ALL ".join(
    f"SELECT amount_usd, '{m}' AS model, CAST({e} AS DECIMAL(28,10)) AS fee FROM card_spend"
    for m, e in MODELS_SQL.items()), ["card_spend"])
register("ndays", """
    SELECT CAST(coalesce(greatest(datediff('day', min(CAST(posted_at AS DATE)), max(CAST(posted_at AS DATE))) + 1, 1), 1)
                AS BIGINT) AS n_days, count(amount_usd) AS n, sum(amount_usd) AS s FROM card_spend""", ["card_spend"])
register("bstats", f"""
    SELECT greatest({BIN_SQL}, 0) AS bin, count(*) AS n, sum(amount_usd) AS s FROM card_spend
    WHERE amount_usd IS NOT NULL GROUP BY 1""", ["card_spend"])


@query("card_fee_models", with_views(
    "SELECT CAST(amount_usd AS DOUBLE) AS amount_usd, model, CAST(fee AS DOUBLE) AS fee FROM fees_long", "fees_long"))
def _fee_models(b: Bound):
    f = pr.card_fee_models(card_spend(b))
    return f.select(dbl("amount_usd").alias("amount_usd"), "model", dbl("fee").alias("fee"))


@query("bin_transactions", with_views(f"""
    WITH c AS (SELECT {BIN_SQL} AS bin, count(*) AS cnt FROM card_spend WHERE amount_usd IS NOT NULL AND amount_usd >= 0
               GROUP BY 1), tot AS (SELECT sum(cnt) AS t FROM c)
    SELECT b.bin, b.label, b.midpoint, CAST(coalesce(cnt, 0) AS BIGINT) AS count,
           CASE WHEN coalesce(t, 0) > 0 THEN round(CAST(coalesce(cnt, 0) AS DOUBLE) / CAST(t AS DOUBLE) * 100, 6)
                ELSE 0.0 END AS pct
    FROM {BINS} b LEFT JOIN c ON c.bin = b.bin CROSS JOIN tot""", "card_spend"))
def _bin_tx(b: Bound):
    return pr.bin_transactions(card_spend(b))


@query("fee_comparison", with_views(f"""
    WITH g AS (SELECT {BIN_SQL} AS bin, model, count(*) AS cnt, sum(fee) AS s FROM fees_long WHERE amount_usd >= 0
               GROUP BY 1, 2)
    SELECT b.label, m.model, CAST(coalesce(cnt, 0) AS BIGINT) AS count, {_r('coalesce(s, 0)', 2)} AS fee_total_usd
    FROM {BINS} b CROSS JOIN {_values([(m,) for m in pr.MODELS], ['model'])} m
    LEFT JOIN g ON g.bin = b.bin AND g.model = m.model""", "fees_long"))
def _fee_cmp(b: Bound):
    return pr.fee_comparison(card_spend(b))


register("monthly_models", f"""
    SELECT model, {_r('CAST(sum(fee) AS DOUBLE) / CAST(n_days AS DOUBLE) * 30', 2)} AS monthly_revenue_usd
    FROM fees_long CROSS JOIN ndays GROUP BY model, n_days""", ["fees_long", "ndays"])


@query("monthly_revenue_by_model", with_views("SELECT * FROM monthly_models", "monthly_models"))
def _monthly(b: Bound):
    return pr.monthly_revenue_by_model(card_spend(b))


@query("fee_coverage", with_views(f"""
    SELECT model, {_r('monthly_revenue_usd', 2)} AS revenue_usd, CAST({round(COST, 2)!r} AS DOUBLE) AS cost_usd,
           {_r(f'monthly_revenue_usd / {COST!r}', 4)} AS coverage_ratio,
           {_r(f'monthly_revenue_usd - {COST!r}', 2)} AS margin_usd FROM monthly_models""", "monthly_models"))
def _fee_cov(b: Bound):
    return pr.fee_coverage(pr.monthly_revenue_by_model(card_spend(b)), COST)


@query("coverage_grid", with_views(f"""
    SELECT g.flat_fee, g.pct_fee,
           {_r(f'CAST(CAST(g.flat_fee AS DECIMAL(10,4)) * n + CAST(g.pct_fee AS DECIMAL(10,4)) * coalesce(s, 0) AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 / {COST!r}', 4)} AS coverage_ratio
    FROM {_values([(float(f), float(p)) for f in pr.COVERAGE_FLAT_RANGE for p in pr.COVERAGE_PCT_RANGE], ['flat_fee', 'pct_fee'])} g
    CROSS JOIN ndays""", "ndays"))
def _cov_grid(b: Bound):
    return pr.coverage_grid(card_spend(b), COST)


@query("flat_pct_metrics", with_views(f"""
    WITH t AS (SELECT *, CAST(n AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 AS txm,
                      CAST(coalesce(s, 0) AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 AS vm,
                      {_r('CAST(0.3 * n + 0.01 * coalesce(s, 0) AS DOUBLE) / CAST(n_days AS DOUBLE) * 30', 2)} AS rev FROM ndays)
    SELECT CAST(n_days AS DOUBLE) AS n_days, {_r('txm', 2)} AS tx_month, {_r('vm', 2)} AS volume_month_usd, rev AS revenue_usd,
           CAST({round(COST, 2)!r} AS DOUBLE) AS cost_usd, {_r(f'rev / {COST!r}', 4)} AS coverage_ratio, {_r(f'rev - {COST!r}', 2)} AS margin_usd,
           CASE WHEN vm > 0 THEN {_r(f'greatest(({COST!r} - 0.3 * txm) / vm, 0.0)', 6)} ELSE 'Infinity'::DOUBLE END AS required_pct_with_flat,
           CASE WHEN txm > 0 THEN {_r(f'greatest(({COST!r} - 0.01 * vm) / txm, 0.0)', 4)} ELSE 'Infinity'::DOUBLE END AS required_flat_with_pct
    FROM t""", "ndays"))
def _flat_pct(b: Bound):
    return pr.flat_pct_metrics(card_spend(b), COST, 0.30, 0.01)


register("bin_fee_rev", f"""
    SELECT f.bin, f.label, CAST(coalesce(st.n, 0) AS BIGINT) AS count,
           CASE WHEN t.n > 0 THEN {_r('CAST(coalesce(st.n, 0) AS DOUBLE) / CAST(t.n AS DOUBLE) * 100', 2)} ELSE 0.0 END AS pct_count,
           f.fee_usd, {_r('CAST(CAST(f.fee_usd AS DECIMAL(10,4)) * coalesce(st.n, 0) + CAST(f.pct_fee AS DECIMAL(10,6)) * coalesce(st.s, 0) AS DOUBLE)', 4)} AS revenue_obs_usd,
           {_r('CAST(CAST(f.fee_usd AS DECIMAL(10,4)) * coalesce(st.n, 0) + CAST(f.pct_fee AS DECIMAL(10,6)) * coalesce(st.s, 0) AS DOUBLE) / CAST(t.n_days AS DOUBLE) * 30', 4)} AS revenue_month_usd
    FROM {_values([(i, pr.BIN_LABELS[i], float(pr.BIN_FEE_DEFAULTS[i]), 0.0) for i in range(7)], ['bin', 'label', 'fee_usd', 'pct_fee'])} f
    LEFT JOIN bstats st ON st.bin = f.bin CROSS JOIN ndays t""", ["bstats", "ndays"])


@query("bin_fee_revenue", with_views("SELECT * FROM bin_fee_rev", "bin_fee_rev"))
def _bin_fee_rev(b: Bound):
    return pr.bin_fee_revenue(card_spend(b))


@query("bin_fee_coverage", with_views(f"""
    WITH r AS (SELECT {_r('sum(CAST(revenue_month_usd AS DECIMAL(30,10)))', 2)} AS revenue_usd FROM bin_fee_rev),
         t AS (SELECT CAST(n AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 AS txm FROM ndays)
    SELECT {_r('txm', 2)} AS tx_month, revenue_usd, {_r(f'revenue_usd / {COST!r}', 4)} AS coverage_ratio,
           {_r(f'revenue_usd - {COST!r}', 2)} AS margin_usd,
           CASE WHEN txm > 0 THEN {_r(f'{COST!r} / txm', 4)} ELSE 'Infinity'::DOUBLE END AS breakeven_uniform_flat
    FROM r CROSS JOIN t""", "bin_fee_rev", "ndays"))
def _bin_fee_cov(b: Bound):
    return pr.bin_fee_coverage(card_spend(b), pr.BIN_FEE_DEFAULTS, COST)


def _sweep_terms() -> str:
    terms = []
    for k in range(7):
        fee = "g.j_fee" if k == 1 else "g.i_fee" if k == 0 else repr(float(pr.BIN_FEE_DEFAULTS[k]))
        terms.append(f"CAST({fee} AS DECIMAL(10,4)) * coalesce(n{k}, 0)")
    return " + ".join(terms)


@query("bin_fee_sweep", with_views(f"""
    WITH c AS (SELECT {', '.join(f'sum(CASE WHEN bin = {k} THEN n ELSE 0 END) AS n{k}' for k in range(7))}
               FROM bstats WHERE bin >= 0)
    SELECT g.i_fee, g.j_fee, {_r(f'CAST({_sweep_terms()} AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 / {COST!r}', 4)} AS coverage_ratio
    FROM {_values([(float(a), float(b)) for a in pr.BIN_SWEEP_RANGE for b in pr.BIN_SWEEP_RANGE], ['i_fee', 'j_fee'])} g
    CROSS JOIN c CROSS JOIN ndays""", "bstats", "ndays"))
def _bin_sweep(b: Bound):
    return pr.bin_fee_sweep(card_spend(b), 0, 1)


def _lin_sql(start, end, n, i):
    step = (end - start) / (n - 1)
    return f"(CASE WHEN {i} = {n - 1} THEN {float(end)!r} ELSE CAST({i} AS DOUBLE) * {step!r} + {float(start)!r} END)"


def _prog_idx(gap: str, n: int) -> str:
    return f"CAST(least(floor(amount_usd / {gap}), {n - 1}) AS INTEGER)"


@query("progressive_fee_breakdown", with_views(f"""
    WITH r AS (SELECT {_prog_idx('20.0', 10)} AS i, amount_usd FROM card_spend WHERE amount_usd IS NOT NULL),
         g AS (SELECT i, count(*) AS n,
                      sum(CAST({_lin_sql(pr.PROG_FLAT_START, pr.PROG_FLAT_END, 10, 'i')}
                               + {_lin_sql(pr.PROG_PCT_START, pr.PROG_PCT_END, 10, 'i')} * CAST(amount_usd AS DOUBLE)
                               AS DECIMAL(30,10))) AS rev FROM r GROUP BY 1),
         b AS (SELECT CAST(range AS INTEGER) AS i FROM range(10))
    SELECT CAST(b.i + 1 AS BIGINT) AS bin, CAST(b.i AS DOUBLE) * 20.0 AS from_usd,
           CASE WHEN b.i < 9 THEN (CAST(b.i AS DOUBLE) + 1) * 20.0 ELSE 'Infinity'::DOUBLE END AS to_usd,
           {_lin_sql(pr.PROG_FLAT_START, pr.PROG_FLAT_END, 10, 'b.i')} AS flat_usd,
           {_lin_sql(pr.PROG_PCT_START, pr.PROG_PCT_END, 10, 'b.i')} AS pct,
           CAST(coalesce(g.n, 0) AS BIGINT) AS count,
           CASE WHEN t.n > 0 THEN {_r('CAST(coalesce(g.n, 0) AS DOUBLE) / CAST(t.n AS DOUBLE) * 100', 2)} ELSE 0.0 END AS pct_count,
           round(CAST(coalesce(g.rev, 0) AS DOUBLE) / CAST(t.n_days AS DOUBLE) * 30, 6) AS revenue_month_usd,
           round(CAST(coalesce(g.rev, 0) AS DOUBLE) / CAST(t.n_days AS DOUBLE) * 30 / {COST!r}, 6) AS invoice_factor
    FROM b LEFT JOIN g ON g.i = b.i CROSS JOIN ndays t""", "card_spend", "ndays"))
def _prog(b: Bound):
    return pr.progressive_fee_breakdown(card_spend(b), 10, 20.0)


@query("progressive_sweep", with_views(f"""
    SELECT gap, round(CAST(rev AS DOUBLE) / CAST(n_days AS DOUBLE) * 30, 6) AS revenue_usd,
           round(CAST(rev AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 / {COST!r}, 6) AS coverage_ratio
    FROM (SELECT gap, sum(CAST({_lin_sql(pr.PROG_FLAT_START, pr.PROG_FLAT_END, 10, 'i')}
                               + {_lin_sql(pr.PROG_PCT_START, pr.PROG_PCT_END, 10, 'i')} * CAST(amount_usd AS DOUBLE)
                               AS DECIMAL(30,10))) AS rev
          FROM (SELECT gap, amount_usd, {_prog_idx('gap', 10)} AS i FROM card_spend
                CROSS JOIN {_values([(g,) for g in GAPS], ['gap'])} gg WHERE amount_usd IS NOT NULL) GROUP BY gap)
    CROSS JOIN ndays""", "card_spend", "ndays"))
def _prog_sweep(b: Bound):
    return pr.progressive_sweep(card_spend(b), GAPS, 10)


_SC = _values([(lab, t, s) for lab, t, s in SCENARIOS], ["scenario", "tx_mult", "size_mult"])


def _scaled_fees_sql() -> str:
    x = "(amount_usd * CAST(size_mult AS DECIMAL(10,4)))"
    exprs = {m: e.replace("amount_usd", x) for m, e in MODELS_SQL.items()}
    return " UNION ALL ".join(
        f"SELECT scenario, '{m}' AS model, CAST({e} AS DECIMAL(28,10)) AS fee FROM card_spend CROSS JOIN {_SC} sc "
        f"WHERE amount_usd IS NOT NULL" for m, e in exprs.items())


@query("growth_scenarios", with_views(f"""
    WITH g AS (SELECT scenario, model, sum(fee) AS t FROM ({_scaled_fees_sql()}) GROUP BY 1, 2),
         med AS (SELECT quantile_cont(CAST(amount_usd AS DOUBLE), 0.5) AS m FROM card_spend)
    SELECT g.scenario, sc.tx_mult, sc.size_mult, {_r('med.m * sc.size_mult', 2)} AS avg_ticket_usd, g.model,
           {_r('CAST(g.t AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 * sc.tx_mult', 2)} AS monthly_revenue_usd
    FROM g JOIN {_SC} sc ON sc.scenario = g.scenario CROSS JOIN ndays CROSS JOIN med""", "card_spend", "ndays"))
def _growth(b: Bound):
    return pr.growth_scenarios(card_spend(b), [s[1] for s in SCENARIOS], [s[2] for s in SCENARIOS],
                               [s[0] for s in SCENARIOS])


register("tsweep", f"""
    SELECT t.threshold, sc.scenario,
           {_r('CAST(sum(CASE WHEN amount_usd * CAST(sc.size_mult AS DECIMAL(10,4)) < t.threshold THEN 0.30 ELSE round(amount_usd * CAST(sc.size_mult AS DECIMAL(10,4)) * 0.01, 4) END) AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 * sc.tx_mult', 2)} AS monthly_revenue_usd
    FROM card_spend CROSS JOIN {_SC} sc CROSS JOIN {_values([(float(t),) for t in pr.SWEEP_THRESHOLDS], ['threshold'])} t
    CROSS JOIN ndays WHERE amount_usd IS NOT NULL GROUP BY t.threshold, sc.scenario, sc.tx_mult, n_days""",
         ["card_spend", "ndays"])


def _tsweep(b: Bound):
    sc = b.spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(lab).alias("scenario"), F.lit(t).alias("tx_mult"), F.lit(s).alias("size_mult"))
        for lab, t, s in SCENARIOS])))
    return pr.threshold_sweep(card_spend(b), pr.SWEEP_THRESHOLDS, sc)


@query("threshold_sweep", with_views("SELECT * FROM tsweep", "tsweep"))
def _threshold_sweep(b: Bound):
    return _tsweep(b)


@query("best_threshold", with_views("""
    SELECT scenario, arg_max(threshold, (monthly_revenue_usd, -threshold)) AS best_threshold,
           max(monthly_revenue_usd) AS best_monthly_revenue_usd FROM tsweep GROUP BY 1""", "tsweep"))
def _best_threshold(b: Bound):
    return pr.best_threshold(_tsweep(b))


@query("flat_threshold_grid", with_views(f"""
    SELECT f.flat_fee, t.threshold,
           {_r('CAST(sum(CASE WHEN amount_usd * 1.0 < t.threshold THEN CAST(f.flat_fee AS DECIMAL(10,4)) ELSE amount_usd * 1.0 * 0.01 END) AS DOUBLE) / CAST(n_days AS DOUBLE) * 30 * 1.0', 2)} AS monthly_rev
    FROM card_spend CROSS JOIN {_values([(float(x),) for x in FLATS], ['flat_fee'])} f
    CROSS JOIN {_values([(float(t),) for t in pr.SWEEP_THRESHOLDS], ['threshold'])} t CROSS JOIN ndays
    WHERE amount_usd IS NOT NULL GROUP BY f.flat_fee, t.threshold, n_days""", "card_spend", "ndays"))
def _flat_thr(b: Bound):
    return pr.flat_threshold_grid(card_spend(b), FLATS, pr.SWEEP_THRESHOLDS, 0.01, 1.0, 1.0)


def _tier_sql(rows, mode: str) -> str:
    tv = _values(rows, ["tier", "lo", "hi", "fee"])
    rev = ("CAST(fee AS DECIMAL(12,6)) * coalesce(txs, 0)" if mode == "flat"
           else "coalesce(j.s, 0) * CAST(fee AS DECIMAL(12,6)) / 100")
    return f"""
    WITH j AS (SELECT t.tier, count(c.amount_usd) AS txs, sum(c.amount_usd) AS s FROM card_spend c
               JOIN {tv} t ON c.amount_usd >= t.lo AND (t.hi IS NULL OR c.amount_usd < t.hi) GROUP BY 1)
    SELECT t.tier, t.lo, t.hi, CAST(coalesce(txs, 0) AS BIGINT) AS txs,
           round(CAST(coalesce(txs, 0) AS DOUBLE) * 100 / CAST(greatest(n, 1) AS DOUBLE), 6) AS pct_total,
           round(CAST({rev} AS DOUBLE) * (30.0 / CAST(greatest(n_days, 1) AS DOUBLE)), 6) AS revenue_30d_usd
    FROM {tv} t LEFT JOIN j ON j.tier = t.tier CROSS JOIN ndays"""


@query("tier_breakdown", with_views(_tier_sql(FLAT_TIERS, "flat"), "card_spend", "ndays"))
def _tier_flat(b: Bound):
    return pr.tier_breakdown(card_spend(b), _tiers(b, FLAT_TIERS), "flat")


@query("tier_breakdown_pct", with_views(_tier_sql(PCT_TIERS, "pct"), "card_spend", "ndays"))
def _tier_pct(b: Bound):
    return pr.tier_breakdown(card_spend(b), _tiers(b, PCT_TIERS), "pct")


@query("tier_range_join", with_views(f"""
    SELECT CAST(c.amount_usd AS DOUBLE) AS amount_usd, t.tier FROM card_spend c
    LEFT JOIN {_values(PCT_TIERS, ['tier', 'lo', 'hi', 'fee'])} t
      ON c.amount_usd >= t.lo AND (t.hi IS NULL OR c.amount_usd < t.hi)""", "card_spend"))
def _tier_join(b: Bound):
    j = pr.tier_range_join(card_spend(b), _tiers(b, PCT_TIERS))
    return j.select(dbl("amount_usd").alias("amount_usd"), "tier")


@query("amount_histogram", with_views("""
    WITH p AS (SELECT quantile_cont(CAST(amount_usd AS DOUBLE), 0.99) AS p99 FROM card_spend),
         x AS (SELECT least(CAST(amount_usd AS DOUBLE), p99 * 1.1) AS v FROM card_spend CROSS JOIN p WHERE amount_usd IS NOT NULL),
         r AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
         b AS (SELECT CAST(CASE WHEN (hi - lo) / 60 > 0 THEN least(floor((v - lo) / ((hi - lo) / 60)), 59) ELSE 0 END AS BIGINT) AS bin,
                      lo, hi FROM x CROSS JOIN r)
    SELECT bin, round(lo + (hi - lo) / 60 * bin, 6) AS bin_start, round(lo + (hi - lo) / 60 * (bin + 1), 6) AS bin_end,
           count(*) AS count FROM b GROUP BY bin, lo, hi""", "card_spend"))
def _hist(b: Bound):
    return pr.amount_histogram(card_spend(b), 60)


register("daily_cards", """
    WITH d AS (SELECT CAST(posted_at AS DATE) AS "date", count(amount_usd) AS c, sum(amount_usd) AS v FROM card_spend GROUP BY 1),
         sp AS (SELECT CAST(unnest(generate_series(min("date"), max("date"), INTERVAL 1 DAY)) AS DATE) AS "date" FROM d)
    SELECT sp."date", CAST(coalesce(c, 0) AS BIGINT) AS daily_count, CAST(coalesce(v, 0) AS DOUBLE) AS daily_volume_usd
    FROM sp LEFT JOIN d ON d."date" = sp."date" """, ["card_spend"])


@query("build_daily", with_views("SELECT * FROM daily_cards", "daily_cards"))
def _build_daily(b: Bound):
    return pr.build_daily(card_spend(b))


@query("weekday_patterns", with_views("""
    WITH g AS (SELECT isodow("date") - 1 AS dow, count(daily_count) AS days, count(*) FILTER (WHERE daily_count > 0) AS act,
                      sum(CASE WHEN daily_volume_usd > 0 THEN CAST(daily_volume_usd AS DECIMAL(30,10)) END) AS vs,
                      count(*) FILTER (WHERE daily_volume_usd > 0) AS vn FROM daily_cards GROUP BY 1)
    SELECT CAST(d.range AS BIGINT) AS dow,
           coalesce(round(CAST(act * 100 AS DOUBLE) / CAST(NULLIF(days, 0) AS DOUBLE), 6), 0.0) AS active_rate_pct,
           coalesce(round(CAST(vs AS DOUBLE) / CAST(NULLIF(vn, 0) AS DOUBLE), 6), 0.0) AS avg_spend_active_usd
    FROM range(7) d LEFT JOIN g ON g.dow = d.range""", "daily_cards"))
def _weekday(b: Bound):
    return pr.weekday_patterns(pr.build_daily(card_spend(b)))
