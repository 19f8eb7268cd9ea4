"""The one-pass ledger against separate streams; scans over many small Arrow
batches; series longer than a fold block; the regression's edge cases."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import invoices as iv
from ledgerlens.operators import campaigns, scan, series, users
from ledgerlens.sources.binding import Bound

from .conftest import SF_SMALL


def _separate(b: Bound):
    st = F.col("status")

    def stream(df, value, ts="created_at", user="user_id"):
        return df.select(F.col(user).alias("user_id"), F.col(ts).alias("ts"), value.alias("value"))

    one = F.lit(1).cast("bigint")
    done = b.card_transactions.where(st == "completed")
    return {
        "card_fee_usd": stream(b.card_annual_fees.where(st == "paid"), F.col("amount_usdc").cast("decimal(28,10)")),
        "billing_usd": stream(b.billing_charges.where(st == "settled"),
                              (F.col("amount").cast("decimal(20,0)") * F.expr("0.000001")).cast("decimal(28,10)")),
        "cashback_usd": stream(b.cashback_rewards.where(st == "completed"),
                               F.col("reward_usd_value").cast("decimal(28,10)")),
        "revenue_share_usd": stream(b.revenue_share_rewards.where(st == "completed"),
                                    F.col("reward_usd_value").cast("decimal(28,10)"), user="source_user_id"),
        "swap_fee_usd": stream(b.swap_transactions, users.swap_fee_usd("USDC").cast("decimal(28,10)"), "timestamp"),
        "payout_fee_usd": stream(b.payouts.where(st == "completed"), F.col("fee_usd").cast("decimal(28,10)")),
        "n_swaps": stream(b.swap_transactions, one, "timestamp"),
        "n_card_tx": stream(done, one, "posted_at"),
        "n_card_spend": stream(done.where((F.col("transaction_type") == "spend") & F.col("posted_at").isNotNull()),
                               one, "posted_at"),
    }


def test_ledger_view_equals_separate_streams(spark):
    b = Bound(spark, SF_SMALL)
    parts = _separate(b)
    by = ("user_id", users.ledger_month())
    want = users.ledger_sums(users.stream_ledger(parts), list(parts), by)
    got = users.ledger_sums(b.card_ledger, list(parts), by).select(*want.columns)
    assert got.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("query", ["user_profit", "cohort_ltv", "campaign_roi", "founders_report", "cohort_retention"])
def test_line_scans(spark, query):
    import __spark_entry__ as E
    plan = E.queries()[query](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [l_orderkey" in line]
    assert 1 <= len(scans) <= 2


def test_position_over_small_batches(spark):
    random.seed(3)
    rows = []
    for i in range(400):
        on = random.random() < 0.5
        amt = round(random.uniform(1, 90), 2)
        rows.append((i, dt.datetime(2024, 1, 1 + i % 28), "brl_to_usdc" if on else "usdc_to_brl",
                     "onramp" if on else "offramp", None if on else amt, amt if on else None,
                     round(random.uniform(5.0, 5.99), 2), random.choice([None, 1, 2])))
    df = spark.createDataFrame(rows, "id long, created_at timestamp, direction string, side string, "
                                     "from_amount_usdc double, to_amount_usdc double, effective_rate double, k long")
    whole = scan.position_pnl(df, keys=("k",), num_partitions=1).toPandas()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = scan.position_pnl(df, keys=("k",), num_partitions=3).toPandas()
        curve = series.lorenz_curve(spark.range(1, 200).select(F.col("id").alias("user_id"),
                                                               F.col("id").cast("double").alias("net_revenue_usd"))).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    order = lambda d: d.sort_values("id").reset_index(drop=True)
    whole, small = order(whole), order(small)
    assert [float(x) for x in whole.pnl_cum_brl] == pytest.approx([float(x) for x in small.pnl_cum_brl], abs=1e-6)
    assert [float(x) for x in whole.position_qty_usdc] == [float(x) for x in small.position_qty_usdc]
    assert list(whole.avg_price_brl_per_usdc.fillna(-1)) == pytest.approx(list(small.avg_price_brl_per_usdc.fillna(-1)))
    assert sorted(curve["rank"]) == list(range(1, 200)) and curve.cum_revenue_pct.max() == pytest.approx(100.0)


def test_ewma_longer_than_a_block(spark):
    n = 3 * series.EWMA_BLOCK + 5
    s = pd.Series([float((i * 37) % 23) for i in range(n)], index=pd.date_range("2020-01-01", periods=n, freq="D"))
    df = spark.createDataFrame([(k, d.date(), v) for k in ("a", "b") for d, v in s.items()], "k string, date date, v double")
    for k in ("a", "b"):
        got = series.ewma_fit(df, "v", keys=("k",)).where(F.col("k") == k).orderBy("date").collect()
        assert [r.ewm for r in got] == pytest.approx(list(s.ewm(span=7, adjust=True).mean()), rel=1e-12)


def test_regression_collinear_constant_and_empty(spark):
    rows = [(1, f"2026-{m:02d}", m * 10, m * 20, 5.0 + 3.0 * m) for m in range(1, 9)]
    rows += [(2, f"2026-{m:02d}", m, 2 * m, 7.0) for m in range(1, 4)] + [(3, "2026-01", None, 1, 2.0)]
    schema = "account_id long, period string, n_transactions long, n_active_cards long, modelled_total_usd double"
    got = {r.account_id: r for r in iv.cost_regression_multi(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 2}                                    # no complete row: no account
    assert got[1].predicted_latest_usd == pytest.approx(29.0) and got[1].r_squared == pytest.approx(1.0)
    assert got[2].r_squared is None and got[2].predicted_latest_usd == pytest.approx(7.0)
    assert iv.cost_regression_multi(spark.createDataFrame([], schema)).isEmpty()


def test_regression_large_values_do_not_cancel(spark):
    rng = np.random.default_rng(5)
    x = 1e9 + rng.uniform(0, 100, 30)
    rows = [(1, f"{i:03d}", float(v), float(2 * v + 1)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "account_id long, period string, tx_volume_usd double, modelled_total_usd double")
    assert iv.cost_regression_multi(df).first().coef_tx_volume_usd == pytest.approx(2.0, rel=1e-6)


def test_baseline_over_all_days_and_both_kyc_counts(spark):
    camps = spark.createDataFrame([("c1", dt.date(2026, 1, 8), dt.date(2026, 1, 20))], "campaign_id string, start date, end date")
    days = spark.createDataFrame([(dt.date(2026, 1, 2), 6), (dt.date(2026, 1, 5), 8), (dt.date(2026, 1, 9), 50)],
                                 "signup_date date, new_signups long")
    assert campaigns.baseline_rate(days, camps, 7).first().baseline == 7.0
    assert campaigns.baseline_rate(days, camps, 7, all_days=True).first().baseline == 2.0
    cohort = spark.createDataFrame([(1, "c1"), (2, "c1")], "user_id long, campaign_id string")
    people = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "user_id long, kyc_level int")
    assert campaigns.kyc_by_level(people, cohort).first().kyc_users == 1
    seen = spark.createDataFrame([(1, "completed", "GREEN", dt.datetime(2026, 1, 9)), (2, "completed", "RED", dt.datetime(2026, 1, 9)),
                                  (2, "pending", "GREEN", None), (3, "completed", "GREEN", dt.datetime(2026, 1, 9))],
                                 "user_id long, status string, review_answer string, completed_at timestamp")
    got = campaigns.kyc_by_verification(seen, cohort).collect()
    assert [(r.campaign_id, r.date, r.kyc_count) for r in got] == [("c1", dt.date(2026, 1, 9), 1)]
