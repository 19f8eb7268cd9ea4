"""ROI / CAC, running spend and channel rows (the original's campaign and
marketing test expectations)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import campaigns as cp


@pytest.fixture()
def camps(spark):
    return spark.createDataFrame(
        [("campaign_1", dt.date(2026, 2, 15), dt.date(2026, 2, 20), D("990.93")),
         ("campaign_2", dt.date(2026, 4, 14), dt.date(2026, 4, 16), D("153.75"))],
        "campaign_id string, start date, end date, total_spend_usd decimal(28,10)")


def _summary(spark, users, tx, rev):
    return spark.createDataFrame([("campaign_1", users, tx, rev)],
                                 "campaign_id string, cohort_users long, transacting_users long, total_revenue_usd double")


def _base(spark, rate=0.0):
    return spark.createDataFrame([("campaign_1", rate), ("campaign_2", 0.0)], "campaign_id string, baseline double")


def test_roas_and_cac(spark, camps):
    roi = {r.campaign_id: r for r in cp.campaign_roi(camps, _summary(spark, 100, 12, 90.0), _base(spark)).collect()}
    c1 = roi["campaign_1"]
    assert c1.duration_days == 6 and c1.total_spend_usd == pytest.approx(990.93)
    assert c1.roas == pytest.approx(90.0 / 990.93, rel=1e-3)
    assert c1.cac_full == pytest.approx(990.93 / 12, rel=1e-3)
    assert c1.transacting_rate == pytest.approx(0.12)
    assert c1.incremental_users_est == 100.0 and c1.cac_incremental == pytest.approx(9.91)
    c2 = roi["campaign_2"]          # no cohort rows at all
    assert c2.cohort_users == 0 and c2.transacting_rate is None and c2.cac_full is None


def test_incremental_users_floor(spark, camps):
    roi = {r.campaign_id: r for r in cp.campaign_roi(camps, _summary(spark, 10, 1, 5.0), _base(spark, 3.0)).collect()}
    assert roi["campaign_1"].incremental_users_est == 0.0      # max(0, 10 - 3 * 6)
    assert roi["campaign_1"].cac_incremental is None
    assert roi["campaign_1"].baseline_rate_per_day == 3.0


def test_cumulative_spend(spark, camps):
    daily = spark.createDataFrame([(dt.date(2026, 2, 14 + i), D(str(v))) for i, v in enumerate([10, 20, 30, 25, 20, 15])],
                                  "date date, daily_spend_usd decimal(28,10)")
    rows = cp.cumulative_spend(daily, camps).orderBy("date").collect()
    cum = [r.cum_spend_usd for r in rows]
    assert cum == sorted(cum) and cum[-1] == pytest.approx(120.0)
    starts = [r.date for r in rows if r.is_campaign_start]
    assert starts == [dt.date(2026, 2, 15)]


def test_channel_comparison(spark, camps):
    roi = cp.campaign_roi(camps, _summary(spark, 100, 12, 90.0), _base(spark))
    acq = spark.createDataFrame([("organic", 40, 12.5), ("paid", 10, 3.0)],
                                "acquisition_source string, n_users long, total_net_revenue_usd double")
    rows = {r.channel: r for r in cp.channel_comparison(roi, acq).collect()}
    assert len(rows) == 3
    assert rows["paid_campaigns"].spend_usd == pytest.approx(990.93 + 153.75)
    assert rows["organic"].spend_usd is None and rows["organic"].roas is None


def test_weighted_cac(spark, camps):
    roi = cp.campaign_roi(camps, _summary(spark, 100, 12, 90.0), _base(spark))
    assert cp.weighted_cac(roi).first().weighted_cac == pytest.approx((990.93 + 153.75) / 100)


def test_cohort_daily_revenue_pivot(spark):
    rows = spark.createDataFrame(
        [("c1", dt.date(2026, 3, 1), D("10"), "conversion"), ("c1", dt.date(2026, 3, 1), D("-2"), "cashback"),
         ("c1", dt.date(2026, 3, 1), D("1.5"), "billing"), ("c1", dt.date(2026, 3, 2), D("4"), "card_fee")],
        "campaign_id string, rev_date date, rev_usd decimal(28,10), src string")
    d = {r.rev_date.isoformat(): r for r in cp.cohort_daily_revenue(rows).collect()}
    assert d["2026-03-01"].daily_rev_usd == pytest.approx(9.5)
    assert d["2026-03-01"].daily_cost_cashback_usd == pytest.approx(2.0)
    assert d["2026-03-02"].daily_rev_card_fees_usd == pytest.approx(4.0)
