"""Ordered scans, exact percentiles and EWMA against plain-Python folds."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.quantiles import exact_percentiles
from ledgerlens.operators import scan, series


def _pnl_loop(rows):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    q, avg, cum, out = 0.0, None, 0, {}
    for r in rows:
        s_in = (r[4] or 0.0) if r[2] == "usdc_to_brl" else 0.0
        s_out = (r[5] or 0.0) if r[2] == "brl_to_usdc" else 0.0
        before = avg
        if s_in > 0:
            tot = q + s_in
            avg = ((q * (avg or 0.0)) + s_in * r[6]) / tot if tot > 0 else r[6]
            q = tot
        if s_out > 0:
            q -= s_out
        cum += round((r[6] - before) * s_out * 1e8) if (s_out > 0 and before is not None) else 0
        out[r[0]] = (q, avg, cum / 1e8)
    return out


@pytest.fixture(scope="module")
def events(spark):
    random.seed(7)
    rows = []
    for i in range(1200):
        on = random.random() < 0.55
        amt = round(random.uniform(1, 400), 2)
        rows.append((i, dt.datetime(2024, 1, 1 + i % 28, i % 24), "brl_to_usdc" if on else "usdc_to_brl",
                     "onramp" if on else "offramp", None if on else amt, amt if on else None,
                     round(random.uniform(5.0, 5.99), 2), i % 3))
    df = spark.createDataFrame(rows, "id long, created_at timestamp, direction string, side string, "
                                     "from_amount_usdc double, to_amount_usdc double, effective_rate double, k long")
    return rows, df


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_position_pnl_matches_sequential_fold(events, keys):
    rows, df = events
    res = scan.position_pnl(df, keys=keys, num_partitions=5).collect()
    exp = {}
    if keys:
        for k in range(3):
            exp.update(_pnl_loop([r for r in rows if r[7] == k]))
    else:
        exp = _pnl_loop(rows)
    assert len(res) == len(rows)
    for r in res:
        q, avg, cum = exp[r["id"]]
        assert float(r["position_qty_usdc"]) == pytest.approx(q, abs=1e-6)
        assert (avg is None) == (r["avg_price_brl_per_usdc"] is None)
        if avg is not None:
            assert r["avg_price_brl_per_usdc"] == pytest.approx(avg, rel=1e-12)
        assert float(r["pnl_cum_brl"]) == pytest.approx(cum, abs=1e-6)


def test_exact_percentiles_match_numpy(spark):
    random.seed(1)
    rows = [(random.choice("abc"), float(random.randint(0, 60))) for _ in range(2000)] + [("d", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for acc in (10, 10_000):
        got = {r.k: (r.p10, r.p50, r.p90) for r in
               exact_percentiles(df, "v", {"p10": .1, "p50": .5, "p90": .9}, ["k"], bound=acc).collect()}
        for k in "abcd":
            vals = [v for kk, v in rows if kk == k]
            assert got[k] == pytest.approx(tuple(np.quantile(vals, q) for q in (.1, .5, .9)))


def test_ewma_matches_pandas(spark):
    s = pd.Series([3.0, 5.0, 0.0, 8.0, 2.0, 9.0, 4.0, 4.0, 1.0, 7.0],
                  index=pd.date_range("2024-01-01", periods=10, freq="D"))
    df = spark.createDataFrame([(d.date(), v) for d, v in s.items()], "date date, v double")
    got = series.ewma_fit(df, "v").orderBy("date").collect()
    exp = s.ewm(span=7, adjust=True).mean()
    std = (s - exp).rolling(7, min_periods=1).std().fillna(0)
    assert [r.ewm for r in got] == pytest.approx(list(exp))
    assert [r.rolling_std for r in got] == pytest.approx(list(std))


def test_ewma_forecast_floor_and_band(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 5)) for i in range(40)],
                               "date date, v double")
    fc = series.ewma_forecast(df, "v").orderBy("h").collect()
    assert [r.h for r in fc] == [1, 2, 3, 4, 5]
    assert all(r.forecast >= 0 and r.ci_lower <= r.forecast <= r.ci_upper for r in fc)
    widths = [r.ci_upper - r.forecast for r in fc]
    assert widths == sorted(widths)


def test_lorenz_ends_at_100(spark):
    df = spark.createDataFrame([(i, float(i % 17) - 3) for i in range(300)], "user_id long, net_revenue_usd double")
    lc = series.lorenz_curve(df).orderBy("rank").collect()
    assert lc[-1].cum_revenue_pct == pytest.approx(100.0) and lc[-1].cum_users_pct == pytest.approx(100.0)
    vals = [r.net_revenue_usd for r in lc]
    assert vals == sorted(vals, reverse=True)
    top = series.top_decile_share(df).first()
    pos = sorted([float(i % 17) - 3 for i in range(300) if (i % 17) - 3 > 0], reverse=True)
    k = max(1, len(pos) // 10)
    assert top.top_decile_share_pct == pytest.approx(sum(pos[:k]) / sum(pos) * 100, abs=1e-6)
