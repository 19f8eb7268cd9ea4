"""Ramp metrics on the reference's hand fixtures (F1, F2)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ramp

CONV_SCHEMA = ("id string, user_id string, direction string, from_amount_brl decimal(18,2), "
               "from_amount_usdc decimal(18,6), to_amount_brl decimal(18,2), to_amount_usdc decimal(18,6), "
               "exchange_rate decimal(6,2), effective_rate decimal(6,2), fee_amount_brl decimal(18,2), "
               "fee_amount_usdc decimal(18,6), spread_revenue_brl decimal(18,2), spread_revenue_usdc decimal(18,6), "
               "spread_percentage decimal(6,2), created_at timestamp")


def _ts(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture()
def conv4(spark):
    rows = [
        ("a1", "u2", "usdc_to_brl", D("0"), D("200"), D("1040"), D("0"), D("5.20"), D("5.20"), D("8"), D("0"), D("4"), D("0"), D("0.4"), _ts("2026-01-05")),
        ("a2", "u3", "usdc_to_brl", D("0"), D("400"), D("2080"), D("0"), D("5.20"), D("5.20"), D("16"), D("0"), D("8"), D("0"), D("0.4"), _ts("2026-01-10")),
        ("a3", "u1", "brl_to_usdc", D("1000"), D("0"), D("0"), D("192.31"), D("5.20"), D("5.20"), D("10"), D("0"), D("5"), D("0"), D("0.5"), _ts("2026-02-03")),
        ("a4", "u1", "brl_to_usdc", D("2000"), D("0"), D("0"), D("384.62"), D("5.20"), D("5.20"), D("20"), D("0"), D("10"), D("0"), D("0.5"), _ts("2026-02-15")),
    ]
    return spark.createDataFrame(rows, CONV_SCHEMA)


def test_kpis(conv4):
    k = ramp.ramp_kpis(ramp.normalize_conversions(conv4)).first()
    assert k.total_conversions == 4 and k.unique_users == 3
    assert k.onramp_conversions == 2 and k.offramp_conversions == 2
    assert k.revenue_brl == pytest.approx(81.0)


def test_user_behavior_one_repeat(conv4):
    b = ramp.user_behavior(ramp.normalize_conversions(conv4)).first()
    assert b.unique_users == 3 and b.repeat_users == 1


def test_implied_fx_near_rate(conv4):
    fx = ramp.fx_stats(ramp.normalize_conversions(conv4), "M").collect()
    for r in fx:
        assert r.fx_mean == pytest.approx(5.20, rel=0.01)


def test_monthly_revenue_split(spark, conv4):
    extra = spark.createDataFrame([("a5", "u4", "brl_to_usdc", D("500"), D("0"), D("0"), D("96"), D("5.20"), D("5.20"),
                                    D("0"), D("0"), D("47"), D("0"), D("0.5"), _ts("2026-02-20"))], CONV_SCHEMA)
    m = {r.month.isoformat(): r for r in ramp.revenue_monthly(conv4.unionByName(extra)).collect()}
    assert m["2026-01-01"].fee_brl == pytest.approx(24.0)
    assert m["2026-02-01"].spread_brl == pytest.approx(62.0)
    assert m["2026-02-01"].total_revenue_brl == pytest.approx(92.0)


def test_pix_net_flow(spark):
    dep = spark.createDataFrame([("d1", "u1", D("1000"), _ts("2026-01-05")), ("d2", "u2", D("2000"), _ts("2026-01-05"))],
                                "id string, user_id string, amount_brl decimal(18,2), created_at timestamp")
    trf = spark.createDataFrame([("t1", "u1", D("500"), _ts("2026-01-06"))],
                                "id string, user_id string, amount_brl decimal(18,2), created_at timestamp")
    d = ramp.pix_daily(dep, trf).orderBy("date").collect()
    assert sum(r.pix_net for r in d) == pytest.approx(2500.0)
    assert [r.pix_in for r in d] == [3000.0, 0.0]


def test_weekly_label_is_monday_that_ends_the_week(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, 0.0), (dt.date(2024, 1, 2), 2.0, 0.0),
                                  (dt.date(2024, 1, 8), 4.0, 0.0), (dt.date(2024, 1, 20), 8.0, 0.0)],
                                 "date date, onramp double, offramp double")
    r = {x.period.isoformat(): x.onramp for x in ramp.resample_volume(days, "W").collect()}
    assert r == {"2024-01-01": 1.0, "2024-01-08": 6.0, "2024-01-15": 0.0, "2024-01-22": 8.0}


def test_scan_window_end_rule():
    from ledgerlens.functions.calendar import end_exclusive
    assert end_exclusive("2026-01-31") == "2026-02-01"
    assert end_exclusive("2026-01-31 12:00:00") == "2026-01-31 12:00:00"


def test_scale_minor_units(spark):
    from ledgerlens.functions.money import scale_minor_units
    df = spark.createDataFrame([(12345, 2500000, "x", 7)], "fee_brl long, fee_usdc long, name string, n int")
    r = scale_minor_units(df).first()
    assert float(r.fee_brl) == 123.45 and float(r.fee_usdc) == 2.5 and r.name == "x" and r.n == 7
