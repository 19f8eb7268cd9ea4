"""Campaign windows, spend and as-of unit cost (fixture F6)."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerlens.operators import campaigns as cp
from ledgerlens.sources.files import read_expense_csv

CSV = "\n".join([
    "id,date,postedDate,type,amount,merchantName,authorizationStatus,currency,cardholderEmail",
    "1,2026-02-15,2026-02-16,spend,-99.00,FACEBK ADS,approved,usd,a@test.com",
    "2,2026-02-16,2026-02-17,spend,-791.93,FACEBK ADS,approved,usd,a@test.com",
    "3,2026-02-20,2026-02-21,spend,-100.00,FACEBK ADS,approved,usd,a@test.com",
    "4,2026-04-14,2026-04-15,spend,-18.00,FACEBK ADS,approved,usd,a@test.com",
    "5,2026-04-15,2026-04-16,spend,-11.00,FACEBK ADS,approved,usd,a@test.com",
    "6,2026-04-16,2026-04-17,spend,-83.17,DL *GOOGLE ADS68758342,approved,usd,b@test.com",
    "7,2026-04-16,2026-04-17,spend,-41.58,Google ADS6875834245,approved,usd,b@test.com",
    "8,2026-01-10,2026-01-11,spend,-50.00,STRIPE,approved,usd,a@test.com",
])


@pytest.fixture()
def spend(spark, tmp_path):
    p = tmp_path / "export.csv"
    p.write_text(CSV)
    return cp.load_ad_spend(read_expense_csv(spark, str(p)))


def test_load_ad_spend(spend):
    rows = {(r.date.isoformat(), r.platform): float(r.daily_spend_usd) for r in spend.collect()}
    assert rows[("2026-02-15", "meta")] == 99.0
    assert rows[("2026-04-16", "google")] == pytest.approx(124.75)
    assert all(p in ("meta", "google") for _, p in rows)


def test_detect_campaigns_gap(spend):
    c = cp.detect_campaigns(cp.aggregate_spend(spend), gap_days=7).orderBy("start").collect()
    assert [r.campaign_id for r in c] == ["campaign_1", "campaign_2"]
    assert c[0].start == dt.date(2026, 2, 15) and c[0].end == dt.date(2026, 2, 20)
    assert float(c[0].total_spend_usd) == pytest.approx(990.93)
    assert float(c[1].total_spend_usd) == pytest.approx(153.75)


def test_tag_window_and_baseline(spark, spend):
    camps = cp.detect_campaigns(cp.aggregate_spend(spend))
    days = spark.createDataFrame([(dt.date(2026, 2, 10), 2), (dt.date(2026, 2, 12), 3), (dt.date(2026, 2, 16), 5),
                                  (dt.date(2026, 3, 1), 1)], "signup_date date, new_signups long")
    tags = {r.signup_date.isoformat(): r.campaign_id for r in cp.tag_campaign_window(days, camps, "signup_date").collect()}
    assert tags == {"2026-02-10": "", "2026-02-12": "", "2026-02-16": "campaign_1", "2026-03-01": ""}
    base = {r.campaign_id: r.baseline for r in cp.baseline_rate(days, camps, 7).collect()}
    assert base["campaign_1"] == pytest.approx(2.5)  # mean over days with signups
    assert base["campaign_2"] == 0.0


def test_asof_unit_cost(spark):
    rates = cp.unit_cost_by_period(spark.createDataFrame(
        [("2026-02", D("6693.58"), 6885), ("2026-03", D("7857.40"), 6990), ("2026-05", D("100"), 0)],
        "period string, invoice_total_usd decimal(20,2), n_transactions long"))
    days = spark.createDataFrame([(dt.date(2026, 1, 5), 10), (dt.date(2026, 2, 5), 10), (dt.date(2026, 4, 5), 10),
                                  (dt.date(2026, 3, 9), 0)], "date date, txn_count long")
    r = {x.date.isoformat(): float(x.cogs_usd) for x in cp.asof_unit_cost(days, rates).collect()}
    feb, mar = 6693.58 / 6885, 7857.40 / 6990
    assert r["2026-01-05"] == pytest.approx(10 * feb)   # earlier than all -> earliest
    assert r["2026-02-05"] == pytest.approx(10 * feb)
    assert r["2026-04-05"] == pytest.approx(10 * mar)   # no April invoice -> latest earlier
    assert r["2026-03-09"] == 0.0


def test_running_roas_and_payback(spark):
    d = spark.createDataFrame([(dt.date(2026, 1, 1), 10.0, 100.0), (dt.date(2026, 1, 2), 50.0, 0.0),
                               (dt.date(2026, 1, 3), 90.0, 50.0)], "date date, daily_rev_usd double, daily_spend_usd double")
    r = [x.running_roas for x in cp.running_roas(d).orderBy("date").collect()]
    assert r == [pytest.approx(0.1), pytest.approx(1.0)]
    p = spark.createDataFrame([(dt.date(2026, 1, 1), -5.0), (dt.date(2026, 1, 4), 3.0)], "date date, cum_profit_usd double")
    assert cp.payback_days(p).first().payback_days == 3
