"""Per-user model, segments and cohort rules (fixtures F3-F5)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cohorts, segments, users

from .conftest import SF_SMALL


def test_user_profit_formula(spark):
    joined = spark.createDataFrame(
        [(0, D("116"), D("0"), D("0"), D("0"), 10, 100, D("1"), D("2"), D("3"), D("0.5"), D("0.25"))],
        "user_id int, onramp_revenue_brl decimal(28,10), offramp_revenue_brl decimal(28,10), "
        "onramp_revenue_usdc decimal(28,10), offramp_revenue_usdc decimal(28,10), user_tx_count long, "
        "total_tx_count long, card_fee_usd decimal(28,10), card_tx_fee_usd decimal(28,10), swap_fee_usd decimal(28,10), "
        "cashback_usd decimal(28,10), revenue_share_paid_usd decimal(28,10)")
    fx = spark.createDataFrame([(5.80,)], "fx_rate double")
    r = users.user_profit(joined, fx, invoice_total=6693.58).first()
    assert float(r.onramp_revenue_usd) == pytest.approx(20.0)
    assert float(r.card_cost_allocated_usd) == pytest.approx(6693.58 * 10 / 100)
    assert float(r.kyc_cost_usd) == pytest.approx(2.07)
    expect = 20.0 + 1 + 2 + 3 - 0.5 - 0.25 - 669.358 - 2.07
    assert float(r.net_revenue_usd) == pytest.approx(expect)


def test_mask_and_acquisition_source(spark):
    df = spark.createDataFrame([("abcdefghijk", None, "INV1"), ("u2", "paid", None), ("u3", None, "")],
                               "user_id string, source_type string, invite_code string")
    r = df.select(users.mask_user_id("user_id").alias("m"),
                  users.acquisition_source(F.col("source_type"), F.col("invite_code")).alias("s")).collect()
    assert r[0].m == "abcdefgh..." and r[0].s == "founder_invite"
    assert r[1].s == "paid" and r[2].s == "organic"


def test_time_signals_null_is_dormant(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 4, 1), None), (dt.datetime(2026, 1, 1), dt.datetime(2026, 4, 10, 6))],
                               "signup_date timestamp, last_active_at timestamp")
    r = users.time_signals(df, "2026-04-12 00:00:00").collect()
    assert r[0].days_since_last_active > 10000
    assert r[1].days_since_last_active == 1
    assert r[1].tenure_months == pytest.approx(101 / 30.44)


@pytest.mark.parametrize("days,segment", [(30, "active"), (31, "at_risk"), (90, "at_risk"), (91, "dormant")])
def test_segment_boundaries(spark, days, segment):
    rows = [(f"u{i}", float(i), 0) for i in range(10)] + [("x", 0.0, days)]
    df = spark.createDataFrame(rows, "user_id string, net_revenue_usd double, days_since_last_active int")
    seg = {r.user_id: r.segment for r in segments.classify_segments(df).collect()}
    assert seg["x"] == segment
    assert seg["u9"] == "champion" and seg["u0"] == "active"


def test_segment_shares_sum_to_one(spark):
    rows = [(f"u{i}", float(i % 7), i * 13 % 120) for i in range(50)]
    df = spark.createDataFrame(rows, "user_id string, net_revenue_usd double, days_since_last_active int")
    s = segments.segment_summary(segments.classify_segments(df)).collect()
    assert sum(r.pct_users for r in s) == pytest.approx(1.0, abs=1e-5)


def test_referral_commission(spark):
    df = spark.createDataFrame([("u1", "CODE", "Code", 250, 100.0), ("u2", "CODE", "Code", 250, 300.0),
                                ("u3", None, None, None, 5.0)],
                               "user_id string, referral_code string, referral_code_name string, "
                               "commission_rate_bps int, net_revenue_usd double")
    r = users.referral_code_summary(df).collect()
    assert len(r) == 1 and r[0].n_users == 2
    assert r[0].avg_commission_cost_usd == pytest.approx(200 * 0.025)
    assert r[0].net_arpu_after_commission == pytest.approx(195.0)


def test_cohort_ltv_and_kyc(spark):
    conv_m = spark.createDataFrame(
        [("u0", dt.date(2026, 1, 1), D("58"), D("0")), ("u0", dt.date(2026, 2, 1), D("58"), D("0")),
         ("u0", dt.date(2026, 3, 1), D("58"), D("0")), ("u1", dt.date(2026, 1, 1), D("116"), D("0")),
         ("u1", dt.date(2026, 2, 1), D("0"), D("5"))],
        "user_id string, month date, conversion_revenue_brl decimal(28,10), conversion_revenue_usdc decimal(28,10)")
    empty = spark.createDataFrame([], "user_id string, month date, value decimal(28,10)")
    streams = {k: empty for k in ("card_fee_usd", "billing_usd", "swap_fee_usd", "cashback_usd", "revenue_share_usd")}
    card_m = spark.createDataFrame([], "user_id string, month date, n_card_txns long")
    base = spark.createDataFrame([("u0", dt.datetime(2026, 1, 3), "organic"), ("u1", dt.datetime(2026, 1, 20), "paid")],
                                 "user_id string, signup_date timestamp, acquisition_source string")
    fx = spark.createDataFrame([(5.80,)], "fx_rate double")
    ltv = cohorts.user_monthly_ltv(conv_m, streams, card_m, base, fx)
    rows = {(r.user_id, r.months_since_signup): r for r in ltv.collect()}
    assert float(rows[("u0", 0)].revenue_usd) == pytest.approx(10 - 2.07)
    assert float(rows[("u0", 2)].cum_ltv) == pytest.approx(30 - 2.07)
    assert float(rows[("u1", 1)].cum_ltv) == pytest.approx(20 - 2.07 + 5)
    c = {r.months_since_signup: r.ltv_usd for r in cohorts.cohort_ltv(ltv).collect()}
    assert c[0] == pytest.approx(((10 - 2.07) + (20 - 2.07)) / 2)
    ret = {r.months_since_signup: r.retention for r in cohorts.cohort_retention(ltv).collect()}
    assert ret[0] == 1.0 and ret[2] == 0.5


def test_cac_breakeven(spark):
    df = spark.createDataFrame([("a", 0, D("5")), ("a", 1, D("12")), ("a", 2, D("30")), ("b", 0, D("1"))],
                               "acquisition_source string, months_since_signup long, cum_ltv decimal(28,10)")
    r = {x.acquisition_source: x for x in cohorts.cac_breakeven(df, 10.0).collect()}
    assert r["a"].payback_months == 1 and r["a"].ltv_at_month_12 == pytest.approx(30.0)
    assert r["b"].payback_months is None


def test_ltv_all_streams_months(spark):
    conv_m = spark.createDataFrame([("u0", dt.date(2026, 1, 1), D("58"), D("0"))],
                                   "user_id string, month date, conversion_revenue_brl decimal(28,10), "
                                   "conversion_revenue_usdc decimal(28,10)")
    fee = spark.createDataFrame([("u0", dt.date(2026, 2, 1), D("3"))], "user_id string, month date, value decimal(28,10)")
    empty = spark.createDataFrame([], "user_id string, month date, value decimal(28,10)")
    streams = {"card_fee_usd": fee, "billing_usd": empty, "swap_fee_usd": empty, "cashback_usd": empty,
               "revenue_share_usd": empty}
    card_m = spark.createDataFrame([], "user_id string, month date, n_card_txns long")
    base = spark.createDataFrame([("u0", dt.datetime(2026, 1, 3), "organic")],
                                 "user_id string, signup_date timestamp, acquisition_source string")
    fx = spark.createDataFrame([(5.80,)], "fx_rate double")
    conv_only = cohorts.user_monthly_ltv(conv_m, streams, card_m, base, fx)
    assert conv_only.count() == 1          # the card-only month is not counted (original rule)
    allm = {r.months_since_signup: r for r in
            cohorts.user_monthly_ltv(conv_m, streams, card_m, base, fx, months="all_streams").collect()}
    assert float(allm[1].cum_ltv) == pytest.approx(10 - 2.07 + 3)


def test_approx_percentile_mode(spark):
    from ledgerlens.functions.quantiles import exact_percentiles
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    r = exact_percentiles(df, "v", {"m": 0.5}, exact=False).first()
    assert r.m == 50.0


def test_the_lines_are_read_once_for_the_master_table(spark):
    """The sums of the lines are written, so a query that reads master again does not join all lines again; the
    grand total comes from them."""
    from ledgerlens.plans import user_plans
    from ledgerlens.sources.binding import Bound
    b = Bound(spark, SF_SMALL)
    m = user_plans.master(b)
    assert "l_orderkey" not in m._jdf.queryExecution().optimizedPlan().toString()
    closed = b._lines.where("l_linestatus = 'F'").count()
    assert {r[0] for r in m.where("user_tx_count > 0").select("total_tx_count").distinct().collect()} == {closed}
