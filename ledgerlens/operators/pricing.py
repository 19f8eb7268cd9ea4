"""Card-fee pricing: fee models, spend tiers, coverage grids, sweeps, scenarios.

Every sweep is computed from a handful of per-bucket aggregates (count and
sum of amounts) instead of re-scanning the transactions per grid cell:
sum(flat + pct * x) = flat * n + pct * sum(x).  Where per-row rounding blocks
that algebra (the rounded 1% fee), rows are bucketed once per scenario and
the rounded fee is summed per bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import dbl, dlit, fine, money, nz, r6, rnd, safe_div
from ..functions.quantiles import exact_percentiles

# The four fee models and their parameters.
MODEL_A = "A — 1% volume"
MODEL_B = "B — $0,99 fixo"
MODEL_C = "C — $0,30 fixo / 1%"
MODEL_D = "D — 1% c/ teto $5"
MODELS = (MODEL_A, MODEL_B, MODEL_C, MODEL_D)
MODEL_C_FLAT = 0.30
MODEL_C_PCT = 0.01
MODEL_C_THRESHOLD_DEFAULT = 30.0
MODEL_B_FLAT = 0.99
MODEL_D_CAP = 5.00

# Spend tiers [lo, next lo), the last one open.
BIN_EDGES = (0, 10, 25, 50, 100, 200, 500)
BIN_LABELS = ("$0–10", "$10–25", "$25–50", "$50–100", "$100–200", "$200–500", "$500+")
BIN_MIDPOINTS = (5.0, 17.5, 37.5, 75.0, 150.0, 350.0, 750.0)
BIN_FEE_DEFAULTS = (0.30, 0.50, 0.75, 1.00, 1.50, 2.00, 3.00)
BIN_SWEEP_RANGE = tuple(round(v * 0.10, 2) for v in range(1, 21))

# Sweep ranges and the invoice cost to cover.
SWEEP_THRESHOLDS = (5, 10, 15, 20, 25, 30, 40, 50, 60, 75, 100, 125, 150, 200)
COVERAGE_FLAT_RANGE = (0, 0.25, 0.50, 0.75, 1.00, 1.25, 1.50, 2.00)
COVERAGE_PCT_RANGE = (0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03)
INVOICE_COST_DEFAULT = 6693.58
PROG_FLAT_START = 0.30
PROG_FLAT_END = 3.00
PROG_PCT_START = 0.02
PROG_PCT_END = 0.0025


def _rows(*cols: str, data) -> Column:
    """A small constant table as an inline array of structs (stays in the plan)."""
    return F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(cols, row)]) for row in data]))


def const_table(spark_df: DataFrame, cols: tuple[str, ...], data) -> DataFrame:
    return spark_df.sparkSession.range(1).select(_rows(*cols, data=data))


# ------------------------------------------------------------------ basics
def observed_days(spend: DataFrame, ts: str = "posted_at") -> DataFrame:
    """Inclusive calendar days covered by the transactions (at least 1), one row."""
    return spend.agg(F.coalesce(F.greatest(F.datediff(F.max(F.to_date(ts)), F.min(F.to_date(ts))) + 1, F.lit(1)),
                                F.lit(1)).cast("bigint").alias("n_days"))


def model_fees(amount: Column, threshold: float = MODEL_C_THRESHOLD_DEFAULT) -> dict[str, Column]:
    """Per-transaction fee of each model (percent fees rounded to 4 places)."""
    pct = F.round(amount * dlit(MODEL_C_PCT), 4)
    return {
        MODEL_A: pct,
        MODEL_B: dlit(MODEL_B_FLAT) + F.lit(0) * amount,
        MODEL_C: F.when(amount < dlit(threshold), dlit(MODEL_C_FLAT)).otherwise(pct),
        MODEL_D: F.round(F.least(amount * dlit(MODEL_C_PCT), dlit(MODEL_D_CAP)), 4),
    }


def card_fee_models(spend: DataFrame, threshold: float = MODEL_C_THRESHOLD_DEFAULT,
                    amount: str = "amount_usd") -> DataFrame:
    """Unpivot: one row per (transaction, model) with its fee."""
    fees = model_fees(F.col(amount), threshold)
    arr = F.array(*[F.struct(F.lit(m).alias("model"), money(f).alias("fee")) for m, f in fees.items()])
    return spend.select(F.col(amount).alias("amount_usd"), F.inline(arr))


def bin_index(amount: Column) -> Column:
    """Index 0..6 of the spend tier [lo, hi) containing the amount."""
    expr = F.lit(0)
    for edge in BIN_EDGES[1:]:
        expr = expr + (amount >= F.lit(edge)).cast("int")
    return expr


def _bins(df: DataFrame) -> DataFrame:
    return const_table(df, ("bin", "label", "midpoint"),
                       [(i, BIN_LABELS[i], BIN_MIDPOINTS[i]) for i in range(len(BIN_LABELS))])


def bin_transactions(spend: DataFrame, amount: str = "amount_usd") -> DataFrame:
    """Count and percent per tier; empty tiers show 0 (left join from the tier table)."""
    a = F.col(amount)
    c = spend.where(a.isNotNull() & (a >= 0)).groupBy(bin_index(a).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    tot = c.agg(F.sum("count").alias("_tot"))
    j = _bins(spend).join(c, "bin", "left").crossJoin(F.broadcast(tot))
    return j.select("bin", "label", "midpoint", nz("count").cast("bigint").alias("count"),
                    F.when(nz("_tot") > 0, r6(dbl(nz("count")) / dbl("_tot") * 100)).otherwise(F.lit(0.0))
                    .alias("pct"))


def _fee_sums(spend: DataFrame, threshold: float, *keys: Column) -> DataFrame:
    """Row per (keys, model) with count and fee sum ``_s``: the four sums are made
    in one aggregate over the transactions and unpivoted after it."""
    fees = model_fees(F.col("amount_usd"), threshold)
    sums = spend.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"),
                                    *[F.sum(money(f)).alias(f"_f{i}") for i, f in enumerate(fees.values())])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_f{i}").alias("_s")) for i, m in enumerate(fees)])
    return sums.where("count > 0").withColumn("_rows", rows).select("*", F.inline("_rows")).drop(
        "_rows", *[f"_f{i}" for i in range(len(fees))])


def fee_comparison(spend: DataFrame, threshold: float = MODEL_C_THRESHOLD_DEFAULT) -> DataFrame:
    """Sum of each model's fee per tier (rounded to 2), long format."""
    g = _fee_sums(spend.where(F.col("amount_usd") >= 0), threshold, bin_index(F.col("amount_usd")).alias("bin"))
    grid = _bins(spend).crossJoin(const_table(spend, ("model",), [(m,) for m in MODELS]))
    j = grid.join(g, ["bin", "model"], "left")
    return j.select("label", "model", nz("count").cast("bigint").alias("count"),
                    rnd(nz("_s"), 2).alias("fee_total_usd"))


def monthly_revenue_by_model(spend: DataFrame, threshold: float = MODEL_C_THRESHOLD_DEFAULT) -> DataFrame:
    """Total fee / observed days * 30, per model."""
    return _fee_sums(spend, threshold).crossJoin(F.broadcast(observed_days(spend))).select(
        "model", rnd(dbl("_s") / dbl("n_days") * 30, 2).alias("monthly_revenue_usd"))


def fee_coverage(monthly: DataFrame, cost_usd: float = INVOICE_COST_DEFAULT) -> DataFrame:
    c = float(cost_usd)
    return monthly.select(
        "model", rnd("monthly_revenue_usd", 2).alias("revenue_usd"), F.lit(round(c, 2)).alias("cost_usd"),
        (rnd(F.col("monthly_revenue_usd") / F.lit(c), 4) if c else F.lit(0.0)).alias("coverage_ratio"),
        rnd(F.col("monthly_revenue_usd") - F.lit(c), 2).alias("margin_usd"))


def _totals(spend: DataFrame, amount: str = "amount_usd") -> DataFrame:
    """One row: n, sum(amount), observed days."""
    return spend.agg(F.count(F.col(amount)).alias("n"), F.sum(F.col(amount)).alias("s"),
                     F.coalesce(F.greatest(F.datediff(F.max(F.to_date("posted_at")),
                                                      F.min(F.to_date("posted_at"))) + 1, F.lit(1)), F.lit(1))
                     .cast("bigint").alias("n_days"))


def coverage_grid(spend: DataFrame, cost_usd: float = INVOICE_COST_DEFAULT, flat_range=COVERAGE_FLAT_RANGE,
                  pct_range=COVERAGE_PCT_RANGE) -> DataFrame:
    """flat x pct grid of 30-day coverage: flat * n + pct * sum(x) on one aggregate row."""
    grid = const_table(spend, ("flat_fee", "pct_fee"),
                       [(float(f), float(p)) for f in flat_range for p in pct_range])
    t = _totals(spend)
    total_fee = F.col("flat_fee").cast("decimal(10,4)") * F.col("n") + F.col("pct_fee").cast("decimal(10,4)") * nz("s")
    monthly = dbl(total_fee) / dbl("n_days") * 30
    return grid.crossJoin(t).select("flat_fee", "pct_fee",
                                    rnd(monthly / F.lit(float(cost_usd)), 4).alias("coverage_ratio"))


def flat_pct_metrics(spend: DataFrame, cost_usd: float = INVOICE_COST_DEFAULT, flat_fee: float = 0.30,
                     pct_fee: float = 0.01) -> DataFrame:
    """30-day revenue, coverage and breakeven flat / percent for flat + pct * x."""
    t = _totals(spend)
    c = float(cost_usd)
    tx_month = dbl("n") / dbl("n_days") * 30
    vol_month = dbl(nz("s")) / dbl("n_days") * 30
    revenue = rnd(dbl(dlit(flat_fee) * F.col("n") + dlit(pct_fee) * nz("s")) / dbl("n_days") * 30, 2)
    inf = F.lit(float("inf"))
    return t.select(
        dbl("n_days").alias("n_days"), rnd(tx_month, 2).alias("tx_month"), rnd(vol_month, 2).alias("volume_month_usd"),
        revenue.alias("revenue_usd"), F.lit(round(c, 2)).alias("cost_usd"),
        rnd(revenue / F.lit(c), 4).alias("coverage_ratio"), rnd(revenue - F.lit(c), 2).alias("margin_usd"),
        F.when(vol_month > 0, rnd(F.greatest((F.lit(c) - F.lit(float(flat_fee)) * tx_month) / vol_month,
                                             F.lit(0.0)), 6)).otherwise(inf).alias("required_pct_with_flat"),
        F.when(tx_month > 0, rnd(F.greatest((F.lit(c) - F.lit(float(pct_fee)) * vol_month) / tx_month,
                                            F.lit(0.0)), 4)).otherwise(inf).alias("required_flat_with_pct"))


def _bin_stats(spend: DataFrame, amount: str = "amount_usd") -> DataFrame:
    a = F.col(amount)
    return spend.where(a.isNotNull()).groupBy(F.greatest(bin_index(a), F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(a).alias("s"))


def bin_fee_revenue(spend: DataFrame, bin_fees=BIN_FEE_DEFAULTS, bin_pct_fees=None) -> DataFrame:
    """Per tier: count, share, flat + pct fee, observed and 30-day revenue."""
    if len(bin_fees) != len(BIN_LABELS):
        raise ValueError(f"bin_fees must have {len(BIN_LABELS)} elements")
    pcts = bin_pct_fees if bin_pct_fees is not None else [0.0] * len(BIN_LABELS)
    if len(pcts) != len(BIN_LABELS):
        raise ValueError(f"bin_pct_fees must have {len(BIN_LABELS)} elements")
    fees = const_table(spend, ("bin", "label", "fee_usd", "pct_fee"),
                       [(i, BIN_LABELS[i], float(bin_fees[i]), float(pcts[i])) for i in range(len(BIN_LABELS))])
    st = _bin_stats(spend)
    t = _totals(spend)
    j = fees.join(st, "bin", "left").crossJoin(F.broadcast(t.select(F.col("n").alias("_tot"), "n_days")))
    rev = dbl(F.col("fee_usd").cast("decimal(10,4)") * nz("n") + F.col("pct_fee").cast("decimal(10,6)") * nz("s"))
    return j.select("bin", "label", nz("n").cast("bigint").alias("count"),
                    F.when(F.col("_tot") > 0, rnd(dbl(nz("n")) / dbl("_tot") * 100, 2)).otherwise(F.lit(0.0))
                    .alias("pct_count"),
                    "fee_usd", rnd(rev, 4).alias("revenue_obs_usd"),
                    rnd(rev / dbl("n_days") * 30, 4).alias("revenue_month_usd"))


def bin_fee_coverage(spend: DataFrame, bin_fees=BIN_FEE_DEFAULTS, cost_usd: float = INVOICE_COST_DEFAULT) -> DataFrame:
    b = bin_fee_revenue(spend, bin_fees)
    rev = b.agg(rnd(F.sum(fine("revenue_month_usd")), 2).alias("revenue_usd"))
    t = _totals(spend)
    c = float(cost_usd)
    tx_month = dbl("n") / dbl("n_days") * 30
    return t.crossJoin(rev).select(
        rnd(tx_month, 2).alias("tx_month"), "revenue_usd", rnd(F.col("revenue_usd") / F.lit(c), 4).alias("coverage_ratio"),
        rnd(F.col("revenue_usd") - F.lit(c), 2).alias("margin_usd"),
        F.when(tx_month > 0, rnd(F.lit(c) / tx_month, 4)).otherwise(F.lit(float("inf"))).alias("breakeven_uniform_flat"))


def bin_fee_sweep(spend: DataFrame, i_bin: int = 0, j_bin: int = 1, fee_range=BIN_SWEEP_RANGE,
                  fixed_fees=BIN_FEE_DEFAULTS, cost_usd: float = INVOICE_COST_DEFAULT) -> DataFrame:
    """Two tiers swept over a fee range, the rest fixed: 7 tier counts x grid."""
    if len(fixed_fees) != len(BIN_LABELS):
        raise ValueError(f"fixed_fees must have {len(BIN_LABELS)} elements")
    if not (0 <= i_bin < len(BIN_LABELS) and 0 <= j_bin < len(BIN_LABELS)):
        raise ValueError("i_bin and j_bin must be in range 0-6")
    st = _bin_stats(spend).where(F.col("bin") >= 0)
    counts = st.groupBy().agg(*[F.sum(F.when(F.col("bin") == i, F.col("n")).otherwise(F.lit(0))).alias(f"n{i}")
                                for i in range(len(BIN_LABELS))])
    grid = const_table(spend, ("i_fee", "j_fee"), [(float(a), float(b)) for a in fee_range for b in fee_range])
    t = observed_days(spend)
    terms = []
    for k in range(len(BIN_LABELS)):
        fee = (F.col("j_fee") if k == j_bin else F.col("i_fee") if k == i_bin else F.lit(float(fixed_fees[k])))
        terms.append(fee.cast("decimal(10,4)") * nz(F.col(f"n{k}")))
    rev = reduce(lambda a, b: a + b, terms)
    return grid.crossJoin(counts).crossJoin(t).select(
        "i_fee", "j_fee", rnd(dbl(rev) / dbl("n_days") * 30 / F.lit(float(cost_usd)), 4).alias("coverage_ratio"))


def _linspace(start: float, end: float, n: int, i: Column) -> Column:
    if n == 1:
        return F.lit(float(start))
    step = (end - start) / (n - 1)
    return F.when(i == n - 1, F.lit(float(end))).otherwise(i.cast("double") * F.lit(step) + F.lit(float(start)))


def _progressive(spend: DataFrame, n_bins: int, gap_col: Column, flat_start, flat_end, pct_start, pct_end,
                 flat_fees=None, amount: str = "amount_usd") -> tuple[Column, Column, Column]:
    a = F.col(amount)
    idx = F.least(F.floor(a / gap_col), F.lit(n_bins - 1)).cast("int")
    if flat_fees is not None:
        flat = F.element_at(F.array(*[F.lit(float(x)) for x in flat_fees]), idx + 1)
    else:
        flat = _linspace(flat_start, flat_end, n_bins, idx)
    pct = _linspace(pct_start, pct_end, n_bins, idx)
    return idx, flat, pct


def progressive_fee_breakdown(spend: DataFrame, n_bins: int = 10, gap: float = 20.0,
                              flat_start=PROG_FLAT_START, flat_end=PROG_FLAT_END, pct_start=PROG_PCT_START,
                              pct_end=PROG_PCT_END, cost_usd: float = INVOICE_COST_DEFAULT, flat_fees=None,
                              amount: str = "amount_usd") -> DataFrame:
    """Equal-width bins (last one open); flat fee rising, percent falling
    linearly (or explicit flats); per-bin count, share and 30-day revenue."""
    if flat_fees is not None and len(flat_fees) != n_bins:
        raise ValueError(f"flat_fees must have {n_bins} elements")
    idx, flat, pct = _progressive(spend, n_bins, F.lit(float(gap)), flat_start, flat_end, pct_start, pct_end,
                                  flat_fees, amount)
    rows = spend.where(F.col(amount).isNotNull()).select(idx.alias("bin0"),
                                                          fine(flat + pct * dbl(amount)).alias("_fee"))
    g = rows.groupBy("bin0").agg(F.count(F.lit(1)).alias("n"), F.sum("_fee").alias("_rev"))
    sp = spend.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin0"))
    b = sp.select("bin0", _linspace(flat_start, flat_end, n_bins, F.col("bin0")).alias("flat_usd")
                  if flat_fees is None else
                  F.element_at(F.array(*[F.lit(float(x)) for x in flat_fees]), F.col("bin0") + 1).alias("flat_usd"),
                  _linspace(pct_start, pct_end, n_bins, F.col("bin0")).alias("pct"))
    t = _totals(spend, amount)
    j = b.join(g, "bin0", "left").crossJoin(F.broadcast(t.select(F.col("n").alias("_tot"), "n_days")))
    rev_month = dbl(nz("_rev")) / dbl("n_days") * 30
    return j.select(
        (F.col("bin0") + 1).cast("bigint").alias("bin"), (dbl("bin0") * F.lit(float(gap))).alias("from_usd"),
        F.when(F.col("bin0") < n_bins - 1, (dbl("bin0") + 1) * F.lit(float(gap))).otherwise(F.lit(float("inf")))
        .alias("to_usd"),
        "flat_usd", "pct", nz("n").cast("bigint").alias("count"),
        F.when(F.col("_tot") > 0, rnd(dbl(nz("n")) / dbl("_tot") * 100, 2)).otherwise(F.lit(0.0)).alias("pct_count"),
        r6(rev_month).alias("revenue_month_usd"), r6(rev_month / F.lit(float(cost_usd))).alias("invoice_factor"))


def progressive_sweep(spend: DataFrame, gap_values, n_bins: int = 10, flat_start=PROG_FLAT_START,
                      flat_end=PROG_FLAT_END, pct_start=PROG_PCT_START, pct_end=PROG_PCT_END,
                      cost_usd: float = INVOICE_COST_DEFAULT, amount: str = "amount_usd") -> DataFrame:
    """Coverage for many bin widths: transactions x a broadcast list of gaps,
    aggregated per gap map-side (the list is a parameter, not data)."""
    gaps = const_table(spend, ("gap",), [(float(g),) for g in gap_values])
    x = spend.where(F.col(amount).isNotNull()).crossJoin(F.broadcast(gaps))
    _, flat, pct = _progressive(x, n_bins, F.col("gap"), flat_start, flat_end, pct_start, pct_end, None, amount)
    g = x.groupBy("gap").agg(F.sum(fine(flat + pct * dbl(amount))).alias("_rev"))
    t = observed_days(spend)
    rev = dbl("_rev") / dbl("n_days") * 30
    return g.crossJoin(t).select("gap", r6(rev).alias("revenue_usd"),
                                 r6(rev / F.lit(float(cost_usd))).alias("coverage_ratio"))


def growth_scenarios(spend: DataFrame, tx_mults, size_mults, labels,
                     threshold: float = MODEL_C_THRESHOLD_DEFAULT, amount: str = "amount_usd") -> DataFrame:
    """Scenario x model 30-day revenue with scaled ticket sizes and counts, plus
    the scaled median ticket; long format."""
    sc = const_table(spend, ("scenario", "tx_mult", "size_mult"),
                     [(lab, float(t), float(s)) for lab, t, s in zip(labels, tx_mults, size_mults)])
    # One aggregate over the transactions with a sum for each scenario and model.
    sums = []
    for lab, size in zip(labels, size_mults):
        fees = model_fees(F.col(amount) * F.lit(float(size)).cast("decimal(10,4)"), threshold)
        sums += [F.struct(F.lit(lab).alias("scenario"), F.lit(m).alias("model"), F.sum(money(f)).alias("_t"))
                 for m, f in fees.items()]
    g = spend.where(F.col(amount).isNotNull()).agg(F.array(*sums).alias("_s")).select(F.inline("_s")).where("_t IS NOT NULL")
    med = exact_percentiles(spend, amount, {"_med": 0.5})
    j = g.join(sc, "scenario").crossJoin(observed_days(spend)).crossJoin(med)
    return j.select("scenario", "tx_mult", "size_mult", rnd(F.col("_med") * F.col("size_mult"), 2).alias("avg_ticket_usd"),
                    "model", rnd(dbl("_t") / dbl("n_days") * 30 * F.col("tx_mult"), 2).alias("monthly_revenue_usd"))


def _threshold_buckets(x: DataFrame, scaled: Column, thresholds) -> Column:
    ts = sorted(float(t) for t in thresholds)
    return reduce(lambda acc, t: acc + (scaled >= F.lit(t)).cast("int"), ts, F.lit(0))


def threshold_sweep(spend: DataFrame, thresholds, scenarios: DataFrame, amount: str = "amount_usd") -> DataFrame:
    """Model C revenue for every threshold x scenario.  Rows are bucketed once
    per scenario by how many thresholds lie at or below the scaled amount; the
    rounded 1% fee is summed per bucket, then each threshold takes flat fees for
    the buckets below it and percent fees above (cost: rows x scenarios)."""
    ts = sorted(float(t) for t in thresholds)
    sc = scenarios.select("scenario", "tx_mult", "size_mult")
    x = spend.where(F.col(amount).isNotNull()).crossJoin(F.broadcast(sc))
    scaled = F.col(amount) * F.col("size_mult").cast("decimal(10,4)")
    b = x.select("scenario", _threshold_buckets(x, scaled, ts).alias("k"),
                 F.round(scaled * dlit(MODEL_C_PCT), 4).alias("_pct"))
    g = b.groupBy("scenario", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("_pct").alias("r"))
    tt = const_table(spend, ("j", "threshold"), [(j, t) for j, t in enumerate(ts)])
    j = tt.crossJoin(g)
    per = j.groupBy("scenario", "j", "threshold").agg(
        F.sum(F.when(F.col("k") <= F.col("j"), F.col("n")).otherwise(F.lit(0))).alias("n_flat"),
        F.sum(F.when(F.col("k") > F.col("j"), F.col("r")).otherwise(F.lit(0))).alias("r_pct"))
    tot = dlit(MODEL_C_FLAT) * F.col("n_flat") + F.col("r_pct")
    out = per.join(sc, "scenario").crossJoin(observed_days(spend))
    return out.select("threshold", "scenario",
                      rnd(dbl(tot) / dbl("n_days") * 30 * F.col("tx_mult"), 2).alias("monthly_revenue_usd"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold with the highest revenue per scenario (lowest threshold on ties)."""
    return sweep.groupBy("scenario").agg(
        F.max_by("threshold", F.struct(F.col("monthly_revenue_usd"), -F.col("threshold"))).alias("best_threshold"),
        F.max("monthly_revenue_usd").alias("best_monthly_revenue_usd"))


def flat_threshold_grid(spend: DataFrame, flat_fees, thresholds, pct: float = 0.01, tx_mult: float = 1.0,
                        size_mult: float = 1.0, amount: str = "amount_usd") -> DataFrame:
    """flat x threshold revenue: count and sum of scaled amounts per threshold
    bucket, running over the sorted thresholds, then times each flat fee."""
    ts = sorted(float(t) for t in thresholds)
    scaled = F.col(amount) * dlit(size_mult)
    x = spend.where(F.col(amount).isNotNull())
    g = x.groupBy(_threshold_buckets(x, scaled, ts).alias("k")).agg(F.count(F.lit(1)).alias("n"),
                                                                      F.sum(scaled).alias("s"))
    tt = const_table(spend, ("j", "threshold"), [(j, t) for j, t in enumerate(ts)])
    per = tt.crossJoin(g).groupBy("j", "threshold").agg(
        F.sum(F.when(F.col("k") <= F.col("j"), F.col("n")).otherwise(F.lit(0))).alias("n_below"),
        F.sum(F.when(F.col("k") > F.col("j"), F.col("s")).otherwise(F.lit(0))).alias("s_above"))
    ff = const_table(spend, ("flat_fee",), [(float(f),) for f in flat_fees])
    tot = F.col("flat_fee").cast("decimal(10,4)") * F.col("n_below") + dlit(pct) * F.col("s_above")
    return per.crossJoin(ff).crossJoin(observed_days(spend)).select(
        "flat_fee", "threshold", rnd(dbl(tot) / dbl("n_days") * 30 * F.lit(float(tx_mult)), 2).alias("monthly_rev"))


# ------------------------------------------------------------------ tiers
def tier_range_join(spend: DataFrame, tiers: DataFrame, amount: str = "amount_usd") -> DataFrame:
    """Amount in [lo, hi) (or [lo, inf) when hi is null) -> tier.  Tiers are a
    handful of rows and are broadcast."""
    t = F.broadcast(tiers.select("tier", "lo", "hi"))
    a = F.col(amount)
    return spend.join(t, (a >= F.col("lo")) & (F.col("hi").isNull() | (a < F.col("hi"))), "left")


def tier_breakdown(spend: DataFrame, tiers: DataFrame, mode: str = "flat", amount: str = "amount_usd") -> DataFrame:
    """Per tier: transactions, share, 30-day revenue; flat (fee per tx) or pct
    (percent of amount).  tiers: (tier, lo, hi, fee)."""
    j = tier_range_join(spend, tiers, amount)
    g = j.where(F.col("tier").isNotNull()).groupBy("tier").agg(F.count(F.lit(1)).alias("txs"),
                                                               F.sum(amount).alias("_ts"))
    t = _totals(spend, amount)
    k = tiers.join(g, "tier", "left").crossJoin(F.broadcast(t))
    fee = F.col("fee").cast("decimal(12,6)")
    rev = (fee * nz("txs")) if mode == "flat" else (nz("_ts") * fee / F.lit(100))
    return k.select("tier", "lo", "hi", nz("txs").cast("bigint").alias("txs"),
                    r6(dbl(nz("txs")) * 100 / dbl(F.greatest(F.col("n"), F.lit(1)))).alias("pct_total"),
                    r6(dbl(rev) * (F.lit(30.0) / dbl(F.greatest(F.col("n_days"), F.lit(1))))).alias("revenue_30d_usd"))


def amount_histogram(spend: DataFrame, n_bins: int = 60, amount: str = "amount_usd") -> DataFrame:
    """Amounts clipped at 1.1 x p99, then n equal-width bins between min and max."""
    p = exact_percentiles(spend, amount, {"_p99": 0.99})
    x = spend.where(F.col(amount).isNotNull()).crossJoin(F.broadcast(p)).select(
        F.least(dbl(amount), F.col("_p99") * 1.1).alias("v"))
    rng = x.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / n_bins
    b = x.crossJoin(F.broadcast(rng)).select(
        F.when(w > 0, F.least(F.floor((F.col("v") - F.col("_lo")) / w), F.lit(n_bins - 1))).otherwise(F.lit(0))
        .cast("bigint").alias("bin"), "_lo", "_hi")
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"),
                             F.first("_hi").alias("_hi"))
    wd = (F.col("_hi") - F.col("_lo")) / n_bins
    return g.select("bin", r6(F.col("_lo") + wd * F.col("bin")).alias("bin_start"),
                    r6(F.col("_lo") + wd * (F.col("bin") + 1)).alias("bin_end"), "count")


# ----------------------------------------------------------- daily series
def build_daily(spend: DataFrame, ts: str = "posted_at", amount: str = "amount_usd") -> DataFrame:
    """Complete daily count and volume between the first and last day, zero filled."""
    d = spend.groupBy(F.to_date(ts).alias("date")).agg(F.count(amount).alias("daily_count"),
                                                        F.sum(amount).alias("_v"))
    sp = d.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date"))
    return sp.join(d, "date", "left").select("date", nz("daily_count").cast("bigint").alias("daily_count"),
                                             dbl(nz("_v")).alias("daily_volume_usd"))


def weekday_patterns(daily: DataFrame) -> DataFrame:
    """By weekday (0 = Monday): % of days with activity and mean spend on active
    days; all seven weekdays present."""
    d = daily.select(F.weekday("date").alias("dow"), "daily_count", "daily_volume_usd")
    g = d.groupBy("dow").agg(F.count("daily_count").alias("_days"), F.count_if(F.col("daily_count") > 0).alias("_act"),
                             F.sum(F.when(F.col("daily_volume_usd") > 0, fine("daily_volume_usd"))).alias("_vs"),
                             F.count_if(F.col("daily_volume_usd") > 0).alias("_vn"))
    days = daily.sparkSession.range(7).select(F.col("id").cast("int").alias("dow"))
    j = days.join(g, "dow", "left")
    return j.select(F.col("dow").cast("bigint").alias("dow"),
                    F.coalesce(r6(safe_div(F.col("_act") * 100, "_days")), F.lit(0.0)).alias("active_rate_pct"),
                    F.coalesce(r6(safe_div("_vs", F.nullif(F.col("_vn"), F.lit(0)))), F.lit(0.0))
                    .alias("avg_spend_active_usd"))
