"""Card pricing on the two-transaction fixture (F8): 3 observed days."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlens.operators import pricing as pr


@pytest.fixture()
def raw(spark):
    return spark.createDataFrame([(dt.datetime(2026, 1, 1, 10), D("100.00")), (dt.datetime(2026, 1, 3, 9), D("50.00"))],
                                 "posted_at timestamp, amount_usd decimal(18,2)")


def test_monthly_revenue_models(raw):
    m = {r.model: r.monthly_revenue_usd for r in pr.monthly_revenue_by_model(raw).collect()}
    assert m[pr.MODEL_A] == pytest.approx(15.0)
    assert m[pr.MODEL_B] == pytest.approx(0.99 * 2 / 3 * 30)
    assert m[pr.MODEL_D] == pytest.approx(15.0)


def test_flat_pct_metrics(raw):
    r = pr.flat_pct_metrics(raw, 6693.58, 0.30, 0.01).first()
    assert r.revenue_usd == pytest.approx(21.0)
    assert r.tx_month == pytest.approx(20.0) and r.volume_month_usd == pytest.approx(1500.0)


def test_bins_and_sweep_algebra(raw, spark):
    b = {r["label"]: r["count"] for r in pr.bin_transactions(raw).collect()}
    assert b["$50–100"] == 1 and b["$100–200"] == 1 and b["$0–10"] == 0
    ts = spark.range(1).selectExpr("'base' AS scenario", "1.0 AS tx_mult", "1.0 AS size_mult")
    sweep = {r.threshold: r.monthly_revenue_usd for r in pr.threshold_sweep(raw, [60, 200], ts).collect()}
    # threshold 60: 50 -> 0.30 flat, 100 -> 1.00 pct; threshold 200: both flat
    assert sweep[60.0] == pytest.approx((0.30 + 1.00) / 3 * 30)
    assert sweep[200.0] == pytest.approx(0.60 / 3 * 30)


def test_progressive_breakdown(raw):
    rows = pr.progressive_fee_breakdown(raw, n_bins=4, gap=40.0).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 1, 1, 0]
    assert rows[-1].to_usd == float("inf")
    assert rows[0].flat_usd == pytest.approx(0.30) and rows[-1].flat_usd == pytest.approx(3.00)
