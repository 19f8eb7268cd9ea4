"""Vendor-invoice cost model: cost lines from drivers x a rate card, totals,
unit cost, deltas, reconciliation, sensitivity, what-if scenarios, regression,
and invoice-document parsing.  Every operator runs over a table of invoices
(any number of accounts x periods), not one invoice object."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import dbl, dlit, fine, money, nz, rnd, safe_div

# Unit prices of the card-processing rate card (USD).
RATE_CARD = {
    "base_program_fee": 2500.00,
    "virtual_card_fee": 0.20,
    "transaction_fee": 0.075,
    "network_volume_bps": 0.00147,
    "fee_3ds": 0.04,
    "visa_infinite_fee": 1.70,
    "visa_platinum_fee": 0.25,
    "applepay_count_fee": 0.03,
    "applepay_amount_fee": 0.0015,
    "googlepay_count_fee": 0.03,
    "share_token_fee": 1.25,
    "verify_domestic_fee": 0.0075,
    "verify_intl_fee": 0.09,
    "chip_auth_intl_fee": 0.04,
    "network_tx_cost": 0.20,
    "network_3ds_cost": 0.02,
    "cross_border_fee": 0.01,
}

# Cost line -> (driver column, rate-card key); base_program is special.
LINES = (
    ("virtual_cards", "n_active_cards", "virtual_card_fee"),
    ("transaction_fee", "n_transactions", "transaction_fee"),
    ("network_volume", "tx_volume_usd", "network_volume_bps"),
    ("fee_3ds", "n_3ds", "fee_3ds"),
    ("visa_infinite", "n_infinite_txs", "visa_infinite_fee"),
    ("visa_platinum", "n_platinum_txs", "visa_platinum_fee"),
    ("applepay_count", "n_applepay_txs", "applepay_count_fee"),
    ("applepay_amount", "applepay_volume_usd", "applepay_amount_fee"),
    ("googlepay_count", "n_googlepay_txs", "googlepay_count_fee"),
    ("share_token", "n_share_tokens", "share_token_fee"),
    ("verify_domestic", "n_verify_domestic", "verify_domestic_fee"),
    ("verify_intl", "n_verify_intl", "verify_intl_fee"),
    ("chip_auth_intl", "n_chip_auth_intl", "chip_auth_intl_fee"),
    ("network_tx_cost", "n_transactions", "network_tx_cost"),
    ("network_3ds_cost", "n_3ds", "network_3ds_cost"),
    ("cross_border", "n_cross_border", "cross_border_fee"),
)
DRIVERS = ("n_active_cards", "n_transactions", "tx_volume_usd", "n_3ds", "n_infinite_txs", "n_platinum_txs",
           "n_applepay_txs", "applepay_volume_usd", "n_googlepay_txs", "n_share_tokens", "n_verify_domestic",
           "n_verify_intl", "n_chip_auth_intl", "n_cross_border")
INVOICE_SCHEMA = T.StructType(
    [T.StructField("invoice_id", T.StringType()), T.StructField("period", T.StringType()),
     T.StructField("invoice_total_usd", T.DecimalType(20, 2)), T.StructField("base_program_fee", T.DecimalType(20, 2))]
    + [T.StructField(d, T.DecimalType(20, 2) if d.endswith("_usd") else T.LongType()) for d in DRIVERS])


LINE_T = "decimal(28,8)"


def _base_fee(rates: dict) -> Column:
    return F.when(nz("base_program_fee") > 0, F.col("base_program_fee")).otherwise(dlit(rates["base_program_fee"]))


def line_amounts(rates: dict | None = None) -> list[tuple[str, Column]]:
    r = rates or RATE_CARD
    out = [("base_program", _base_fee(r).cast(LINE_T))]
    for line, driver, key in LINES:
        out.append((line, (F.col(driver).cast("decimal(20,2)") * dlit(r[key])).cast(LINE_T)))
    return out


def invoice_cost_lines(invoices: DataFrame, rates: dict | None = None,
                       keys: tuple[str, ...] = ("invoice_id", "account_id", "period")) -> DataFrame:
    """One row per (invoice, cost line): 17 lines, unrounded DECIMAL amounts."""
    arr = F.array(*[F.struct(F.lit(n).alias("line"), a.alias("amount")) for n, a in line_amounts(rates)])
    return invoices.select(*keys, F.inline(arr))


def invoice_totals(invoices: DataFrame, rates: dict | None = None,
                   keys: tuple[str, ...] = ("invoice_id", "account_id", "period")) -> DataFrame:
    """Modelled total per invoice (sum of the lines, row-wise: no shuffle) and
    cost per transaction (null when there are no transactions)."""
    # Re-cast after each addition so the decimal never exceeds 38 digits.
    total = reduce(lambda a, b: (a + b).cast(LINE_T), [a for _, a in line_amounts(rates)])
    return invoices.select(*keys, "n_transactions", F.col("invoice_total_usd").alias("billed_total_usd"),
                           total.alias("modelled_total_usd")).withColumn(
        "cost_per_transaction", F.when(F.col("n_transactions") > 0,
                                       rnd(safe_div("modelled_total_usd", "n_transactions"), 6)))


def cost_lines_rounded(lines: DataFrame) -> DataFrame:
    return lines.select(*[c for c in lines.columns if c != "amount"], rnd("amount", 2).alias("amount_usd"))


def cost_contribution_pct(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Line share of the invoice total in percent (window over one invoice's 17 lines)."""
    w = Window.partitionBy(key)
    return lines.select(key, "line", rnd(safe_div(rnd("amount", 2) * 100, F.sum("amount").over(w)), 2)
                        .alias("pct_of_total"))


def top_cost_drivers(lines: DataFrame, n: int = 5, key: str = "invoice_id") -> DataFrame:
    """First n lines by amount per invoice with their share of the total."""
    w = Window.partitionBy(key)
    wo = Window.partitionBy(key).orderBy(F.col("amount").desc(), F.col("line").asc())
    x = lines.select(key, "line", "amount", F.sum("amount").over(w).alias("_t"),
                     F.row_number().over(wo).alias("rank"))
    return x.where(F.col("rank") <= n).select(key, F.col("rank").cast("bigint").alias("rank"), "line",
                                              rnd("amount", 2).alias("amount_usd"),
                                              rnd(safe_div(F.col("amount") * 100, "_t"), 2).alias("share_pct"))


def latest_invoice(totals: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Most recent invoice per account; billed total if > 0 else the modelled one."""
    g = totals.groupBy(*keys).agg(F.max_by(F.struct("period", "invoice_id", "billed_total_usd",
                                                    "modelled_total_usd"), "period").alias("_l"))
    billed = F.col("_l.billed_total_usd")
    return g.select(*keys, F.col("_l.period").alias("period"), F.col("_l.invoice_id").alias("invoice_id"),
                    dbl(F.when(nz(billed) > 0, billed).otherwise(F.col("_l.modelled_total_usd")))
                    .alias("total_usd"))


def cost_driver_delta(lines: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Per line: change vs the previous period of the same account, % change
    (0 when the previous amount is 0), ranked by absolute change."""
    x = lines.select(*keys, "period", "line", F.round("amount", 2).alias("a"))
    w = Window.partitionBy(*keys, "line").orderBy("period")
    x = x.withColumn("_prev", F.lag("a").over(w)).where(F.col("_prev").isNotNull())
    delta = F.col("a") - F.col("_prev")
    x = x.select(*keys, "period", "line", delta.alias("_d"), "_prev")
    wr = Window.partitionBy(*keys, "period").orderBy(F.abs("_d").desc(), F.col("line").asc())
    return x.select(*keys, "period", "line", dbl("_d").alias("delta_usd"),
                    F.when(F.col("_prev") != 0, rnd(safe_div(F.col("_d") * 100, "_prev"), 4)).otherwise(F.lit(0.0))
                    .alias("delta_pct"), F.row_number().over(wr).cast("bigint").alias("rank"))


def invoice_reconciliation(totals: DataFrame, keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """Billed vs modelled per invoice, unmodelled gap (>= 0), and per account the
    mean invoice total and total transactions (window over one account)."""
    billed = nz("billed_total_usd")
    eff = F.when(billed > 0, billed).otherwise(F.col("modelled_total_usd"))
    w = Window.partitionBy(*keys)
    return totals.select(
        *keys, "period", "invoice_id", dbl(eff).alias("billed_total_usd"),
        rnd("modelled_total_usd", 2).alias("modelled_total_usd"),
        F.when(billed > 0, rnd(F.greatest(billed - F.col("modelled_total_usd"), F.lit(0)), 2)).otherwise(F.lit(0.0))
        .alias("unmodelled_usd"),
        rnd(safe_div(F.sum(eff).over(w), F.count(F.lit(1)).over(w)), 2).alias("avg_total_usd"),
        F.sum("n_transactions").over(w).cast("bigint").alias("total_transactions"))


def invoice_sensitivity(invoices: DataFrame, delta: float = 0.10, rates: dict | None = None,
                        key: str = "invoice_id") -> DataFrame:
    """Cost change when one driver rises by ``delta``: the total is linear in
    each driver, so the change is (sum of its unit rates) x value x delta; the
    base fee moves only when the invoice carries one.  Ranked by |change|."""
    r = rates or RATE_CARD
    per_driver: dict[str, float] = {}
    for _, driver, k in LINES:
        per_driver[driver] = per_driver.get(driver, 0.0) + r[k]
    terms = [F.struct(F.lit(d).alias("driver"),
                      (F.col(d).cast("decimal(20,2)") * dlit(per_driver[d]) * dlit(delta)).alias("_c"))
             for d in DRIVERS]
    terms.append(F.struct(F.lit("base_program_fee").alias("driver"),
                          (nz("base_program_fee").cast("decimal(20,2)") * dlit(delta)).alias("_c")))
    terms.append(F.struct(F.lit("invoice_total_usd").alias("driver"),
                          (F.lit(0).cast("decimal(20,2)") * dlit(delta)).alias("_c")))
    x = invoices.select(key, F.inline(F.array(*[F.struct(t["driver"].alias("driver"),
                                                         t["_c"].cast("decimal(30,8)").alias("_c")) for t in terms])))
    w = Window.partitionBy(key).orderBy(F.abs("_c").desc(), F.col("driver").asc())
    return x.select(key, "driver", rnd("_c", 4).alias("cost_change_usd"),
                    F.row_number().over(w).cast("bigint").alias("rank"))


def invoice_scenarios(invoices: DataFrame, scenarios: DataFrame, rates: dict | None = None,
                      key: str = "invoice_id") -> DataFrame:
    """Base invoices x a (small, broadcast) table of driver overrides: each
    scenario's total and unit cost.  Override columns are named like the drivers
    and null means 'keep the base value'."""
    ov = [c for c in scenarios.columns if c in DRIVERS or c == "base_program_fee"]
    s = scenarios.select("scenario", *[F.col(c).alias(f"_o_{c}") for c in ov])
    j = invoices.crossJoin(F.broadcast(s))
    j = j.select(key, "scenario", *[F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) if c in ov else F.col(c)
                                    for c in list(DRIVERS) + ["base_program_fee"]])
    t = invoice_totals(j.withColumn("invoice_total_usd", F.lit(None).cast("decimal(20,2)"))
                       .withColumn("account_id", F.lit(None)).withColumn("period", F.lit(None)),
                       rates, keys=(key, "scenario"))
    return t.select(key, "scenario", "n_transactions", rnd("modelled_total_usd", 2).alias("total_usd"),
                    "cost_per_transaction")


def cost_regression(totals: DataFrame, x: str = "n_transactions", y: str = "modelled_total_usd",
                    keys: tuple[str, ...] = ("account_id",)) -> DataFrame:
    """One-driver least squares per account over its periods: slope,
    intercept, R^2 and the fitted cost at the latest period."""
    g = totals.groupBy(*keys).agg(
        F.regr_slope(dbl(y), dbl(x)).alias("_b"), F.regr_intercept(dbl(y), dbl(x)).alias("_a"),
        F.regr_r2(dbl(y), dbl(x)).alias("_r2"), F.count(F.lit(1)).alias("n_periods"),
        F.max_by(dbl(x), "period").alias("_xl"))
    return g.select(*keys, "n_periods", F.round("_b", 6).alias("slope"), F.round("_a", 4).alias("intercept"),
                    F.round("_r2", 6).alias("r_squared"),
                    F.round(F.col("_a") + F.col("_b") * F.col("_xl"), 2).alias("predicted_latest_usd"))


# ------------------------------------------------------------- documents
def validate_invoices(df: DataFrame) -> DataFrame:
    """Keep rows whose numeric fields are all present and non-negative."""
    nums = [f.name for f in INVOICE_SCHEMA.fields if isinstance(f.dataType, (T.LongType, T.DecimalType))]
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) >= 0, F.lit(False)) for c in nums])
    return df.where(ok)


def parse_invoice_json(docs: DataFrame, col: str = "json") -> DataFrame:
    """JSON invoice documents (one per row) -> typed, validated rows."""
    p = docs.select(F.from_json(F.col(col), INVOICE_SCHEMA).alias("_i")).select("_i.*")
    return validate_invoices(p)


# The labels of an invoice document and the patterns that read it.
INVOICE_PATTERNS = {
    "invoice_id": r"Invoice number\s+([A-Z0-9]+(?:[\-\(][A-Z0-9]+)+)",
    "invoice_date": r"Invoice date\s+(\w+ \d+, \d{4})",
    "n_active_cards": r"Virtual Cards Fee \((\d[\d,]*) cards?\)",
    "n_transactions": r"Transaction Fee \((\d[\d,]*) transactions?\)",
    "passthrough_bps": r"Network Passthrough Transaction Volume Fee \(([\d.]+) bps\)",
    "passthrough_amt": r"Network Passthrough Transaction Volume Fee.*?\$[\d,]+(?:\.\d+)?\s+\$([\d,]+\.\d+)",
    "n_3ds": r"3D Secure Transactions Fee\s+([\d,]+)",
    "n_infinite_txs": r"Visa Product Type Fee - Infinite\s+([\d,]+)",
    "n_platinum_txs": r"Visa Product Type Fee - Platinum\s+([\d,]+)",
    "n_applepay_txs": r"Tokenized Transaction Count Fee - ApplePay\s+([\d,]+)",
    "applepay_volume": r"Tokenized Transaction Amount Fee - ApplePay\s+([\d,]+)",
    "n_googlepay_txs": r"Tokenized Transaction Count Fee - GooglePay\s+([\d,]+)",
    "n_share_tokens": r"Compliance Check Fee - Share Token\s+([\d,]+)",
    "n_verify_domestic": r"Network Passthrough Account Verification Fee - Domestic\s+([\d,]+)",
    "n_verify_intl": r"Network Passthrough Account Verification Fee - International\s+([\d,]+)",
    "n_chip_auth_intl": r"Network Passthrough Chip Auth.*?International\s+([\d,]+)",
    "n_cross_border": r"Network Passthrough Cross Border Transaction Fee\s+([\d,]+)",
    "base_program_fee": r"Base Program Fee\s+1\s+\$([\d,]+\.\d+)",
}
TOTAL_PATTERNS = (r"(?i)Amount\s+due\s+\$([\d,]+\.\d{2})", r"\bTotal\s+\$([\d,]+\.\d{2})")


def render_invoice_text(invoices: DataFrame, bps: float = 14.7) -> DataFrame:
    """Invoice rows -> invoice document text in the vendor's layout (thousands
    separators, long dates), used to exercise extraction on every invoice."""
    def n(c):
        return F.format_number(F.round(F.col(c), 0), 0)

    def m(c):
        return F.format_number(F.round(c if not isinstance(c, str) else F.col(c), 2), 2)

    vol_fee = F.col("tx_volume_usd") * dlit(bps / 10000)
    date = F.date_format(F.last_day(F.to_date(F.concat(F.col("period"), F.lit("-01")))), "MMMM d, yyyy")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Invoice number "), F.col("invoice_id")),
        F.concat(F.lit("Invoice date "), date),
        F.concat(F.lit("Base Program Fee 1 $"), m("base_program_fee")),
        F.concat(F.lit("Virtual Cards Fee ("), n("n_active_cards"), F.lit(" cards)")),
        F.concat(F.lit("Transaction Fee ("), n("n_transactions"), F.lit(" transactions)")),
        F.concat(F.lit(f"Network Passthrough Transaction Volume Fee ({bps} bps) $"),
                 m("tx_volume_usd"), F.lit(" $"), m(vol_fee)),
        F.concat(F.lit("3D Secure Transactions Fee "), n("n_3ds")),
        F.concat(F.lit("Visa Product Type Fee - Infinite "), n("n_infinite_txs")),
        F.concat(F.lit("Visa Product Type Fee - Platinum "), n("n_platinum_txs")),
        F.concat(F.lit("Tokenized Transaction Count Fee - ApplePay "), n("n_applepay_txs")),
        F.concat(F.lit("Tokenized Transaction Amount Fee - ApplePay "), n("applepay_volume_usd")),
        F.concat(F.lit("Tokenized Transaction Count Fee - GooglePay "), n("n_googlepay_txs")),
        F.concat(F.lit("Compliance Check Fee - Share Token "), n("n_share_tokens")),
        F.concat(F.lit("Network Passthrough Account Verification Fee - Domestic "), n("n_verify_domestic")),
        F.concat(F.lit("Network Passthrough Account Verification Fee - International "), n("n_verify_intl")),
        F.concat(F.lit("Network Passthrough Chip Auth - International "), n("n_chip_auth_intl")),
        F.concat(F.lit("Network Passthrough Cross Border Transaction Fee "), n("n_cross_border")),
        F.concat(F.lit("Total $"), m("invoice_total_usd")),
        F.concat(F.lit("Amount due $"), m("invoice_total_usd")))
    return invoices.select("invoice_id", text.alias("text"))


def extract_invoice_fields(texts: DataFrame, col: str = "text") -> DataFrame:
    """Named-field extraction from invoice document texts with built-in regex
    functions: counts lose thousands separators, the date becomes yyyy-MM, the
    first total pattern that matches wins, volume = amount / (bps / 1e4)."""
    t = F.col(col)

    def grp(key: str) -> Column:
        return F.nullif(F.regexp_extract(t, INVOICE_PATTERNS[key], 1), F.lit(""))

    def num(key: str, typ: str = "bigint") -> Column:
        return F.regexp_replace(grp(key), ",", "").cast(typ)

    total = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in TOTAL_PATTERNS])
    bps = grp("passthrough_bps").cast("decimal(10,4)") * F.expr("0.0001")
    amt = F.regexp_replace(grp("passthrough_amt"), ",", "").cast("decimal(20,2)")
    cols = {
        "invoice_id": F.regexp_replace(grp("invoice_id"), r"\(", "-"),
        "period": F.date_format(F.to_date(grp("invoice_date"), "MMMM d, yyyy"), "yyyy-MM"),
        "invoice_total_usd": F.coalesce(F.regexp_replace(total, ",", "").cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")),
        "base_program_fee": F.coalesce(F.regexp_replace(grp("base_program_fee"), ",", "").cast("decimal(20,2)"),
                                       F.lit(0).cast("decimal(20,2)")),
        "n_active_cards": num("n_active_cards"),
        "n_transactions": num("n_transactions"),
        "tx_volume_usd": F.when(bps > 0, F.round(fine(safe_div(amt, bps)), 2)).otherwise(F.lit(0)),
        "n_3ds": num("n_3ds"),
        "n_infinite_txs": num("n_infinite_txs"),
        "n_platinum_txs": num("n_platinum_txs"),
        "n_applepay_txs": num("n_applepay_txs"),
        "applepay_volume_usd": num("applepay_volume"),
        "n_googlepay_txs": num("n_googlepay_txs"),
        "n_share_tokens": num("n_share_tokens"),
        "n_verify_domestic": num("n_verify_domestic"),
        "n_verify_intl": num("n_verify_intl"),
        "n_chip_auth_intl": F.coalesce(num("n_chip_auth_intl"), F.lit(0).cast("bigint")),
        "n_cross_border": num("n_cross_border"),
    }
    return texts.select(*[v.alias(k) for k, v in cols.items()])


# The drivers of the cost regression.
REGRESSION_FEATURES = ("n_transactions", "n_active_cards", "tx_volume_usd", "n_infinite_txs", "n_platinum_txs",
                       "n_share_tokens", "n_cross_border")
#: Eigenvalues below this share of the largest are taken as collinear drivers.
COLLINEAR = 1e-13


def cost_regression_multi(totals_with_drivers: DataFrame, features=None, y: str = "modelled_total_usd",
                          keys: tuple[str, ...] = ("account_id",), period: str = "period") -> DataFrame:
    """Least squares of cost on several drivers (plus intercept) per account, and
    the cost it predicts for the drivers of the latest period.

    Default drivers: those of REGRESSION_FEATURES that the frame has.  One
    aggregation gives means and covariances (central moments, so large values do
    not cancel); the small systems of all accounts in an Arrow batch are then
    solved together (minimum norm, so collinear drivers and fewer periods than
    drivers are allowed).  Rows with a null driver or cost are left out; no rows
    give no accounts, a constant cost a null r_squared."""
    features = list(features or [f for f in REGRESSION_FEATURES if f in totals_with_drivers.columns])
    cols = [*features, y]
    x = totals_with_drivers.select(*keys, period, *[dbl(c).alias(c) for c in cols]).dropna(subset=cols)
    aggs = [F.count(F.lit(1)).alias("n_periods"), F.max_by(F.array(*features), F.col(period)).alias("_latest"),
            F.array(*[F.avg(c) for c in cols]).alias("_mean"),
            F.array(*[F.covar_pop(a, b) for a in cols for b in cols]).alias("_cov")]
    moments = x.groupBy(*keys).agg(*aggs)
    k = len(features)
    schema = T.StructType([f for f in moments.schema.fields if f.name in keys]
                          + [T.StructField("n_periods", T.LongType()), T.StructField("intercept", T.DoubleType())]
                          + [T.StructField(f"coef_{c}", T.DoubleType()) for c in features]
                          + [T.StructField("r_squared", T.DoubleType()),
                             T.StructField("predicted_latest_usd", T.DoubleType())])

    def solve(batches):
        import numpy as np
        for pdf in batches:
            if pdf.empty:
                continue
            cov = np.stack(pdf["_cov"].to_list()).reshape(-1, k + 1, k + 1)
            mean, latest = np.stack(pdf["_mean"].to_list()), np.stack(pdf["_latest"].to_list())
            beta = (np.linalg.pinv(cov[:, :k, :k], rcond=COLLINEAR, hermitian=True) @ cov[:, :k, k:])[:, :, 0]
            intercept = mean[:, k] - (beta * mean[:, :k]).sum(axis=1)
            explained, spread = (beta * cov[:, :k, k]).sum(axis=1), cov[:, k, k]
            out = pdf[[*keys, "n_periods"]].assign(intercept=intercept)
            for i, c in enumerate(features):
                out[f"coef_{c}"] = beta[:, i]
            flat = spread <= 0
            out["r_squared"] = np.where(flat, np.nan, explained / np.where(flat, 1.0, spread))
            out["predicted_latest_usd"] = intercept + (beta * latest).sum(axis=1)
            yield out

    return moments.mapInPandas(solve, schema)
