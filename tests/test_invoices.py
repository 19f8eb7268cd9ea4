"""Invoice cost model against the two published invoices (F9) and parsing."""

import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import invoices as iv
from ledgerlens.sources.files import read_invoices

FEB = {"invoice_id": "INV-0008", "period": "2026-02", "invoice_total_usd": 6693.58, "base_program_fee": 1000.0,
       "n_active_cards": 577, "n_transactions": 6885, "tx_volume_usd": 265605.44, "n_3ds": 54, "n_infinite_txs": 884,
       "n_platinum_txs": 829, "n_applepay_txs": 4138, "applepay_volume_usd": 117184.0, "n_googlepay_txs": 1312,
       "n_share_tokens": 775, "n_verify_domestic": 160, "n_verify_intl": 354, "n_chip_auth_intl": 1,
       "n_cross_border": 23994}
MAR = {"invoice_id": "INV-0009", "period": "2026-03", "invoice_total_usd": 7857.4, "base_program_fee": 2500.0,
       "n_active_cards": 255, "n_transactions": 6990, "tx_volume_usd": 259278.91, "n_3ds": 85, "n_infinite_txs": 979,
       "n_platinum_txs": 973, "n_applepay_txs": 4175, "applepay_volume_usd": 127250.0, "n_googlepay_txs": 935,
       "n_share_tokens": 316, "n_verify_domestic": 142, "n_verify_intl": 313, "n_chip_auth_intl": 0,
       "n_cross_border": 32194}


@pytest.fixture()
def invoices(spark, tmp_path):
    for i, d in enumerate((FEB, MAR)):
        (tmp_path / f"inv{i}.json").write_text(json.dumps(d, indent=2))
    (tmp_path / "bad.json").write_text(json.dumps({**FEB, "invoice_id": "BAD", "n_3ds": -1}))
    return read_invoices(spark, str(tmp_path)).withColumn("account_id", F.lit(1))


def test_read_rejects_negative(invoices):
    assert sorted(r.invoice_id for r in invoices.collect()) == ["INV-0008", "INV-0009"]


def test_modelled_totals(invoices):
    t = {r.period: float(r.modelled_total_usd) for r in iv.invoice_totals(invoices).collect()}
    assert round(t["2026-02"], 2) == 6693.57
    assert round(t["2026-03"], 2) == 7857.39


def test_rate_card_base_fee_when_missing(invoices):
    no_base = invoices.withColumn("base_program_fee", F.lit(D("0")).cast("decimal(20,2)"))
    t = {r.period: float(r.modelled_total_usd) for r in iv.invoice_totals(no_base).collect()}
    assert round(t["2026-02"], 2) == 8193.57


def test_sensitivity_linear(invoices):
    s = {(r.invoice_id, r.driver): r.cost_change_usd for r in iv.invoice_sensitivity(invoices).collect()}
    assert s[("INV-0008", "n_transactions")] == pytest.approx(6885 * 0.275 * 0.1, abs=1e-4)
    assert s[("INV-0008", "base_program_fee")] == pytest.approx(100.0)
    assert s[("INV-0008", "invoice_total_usd")] == 0.0


def test_top_drivers_and_delta(invoices):
    top = iv.top_cost_drivers(iv.invoice_cost_lines(invoices), 5).where("invoice_id = 'INV-0008'").orderBy("rank").collect()
    assert len(top) == 5 and top[0].line == "visa_infinite" and top[0].amount_usd == pytest.approx(1502.8)
    d = {r.line: r.delta_usd for r in iv.cost_driver_delta(iv.invoice_cost_lines(invoices)).collect()}
    assert d["base_program"] == pytest.approx(1500.0)


def test_extract_round_trip(invoices):
    ex = iv.extract_invoice_fields(iv.render_invoice_text(invoices)).collect()
    by = {r.invoice_id: r for r in ex}
    assert by["INV-0008"].period == "2026-02" and by["INV-0008"].n_cross_border == 23994
    assert float(by["INV-0008"].invoice_total_usd) == 6693.58
    assert float(by["INV-0009"].base_program_fee) == 2500.0
    assert float(by["INV-0008"].tx_volume_usd) == pytest.approx(265605.44, abs=5.0)


def test_cost_regression_multi_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = []
    for acct in (1, 2):
        for m in range(12):
            n, cards, vol = rng.integers(100, 900), rng.integers(10, 90), float(rng.uniform(1e3, 9e4))
            cost = 50 * acct + 0.3 * n + 0.2 * cards + 0.0015 * vol + float(rng.normal(0, 2))
            rows.append((acct, f"2026-{m + 1:02d}", int(n), int(cards), float(vol), float(cost)))
    df = spark.createDataFrame(rows, "account_id long, period string, n_transactions long, n_active_cards long, "
                                     "tx_volume_usd double, modelled_total_usd double")
    got = {r.account_id: r for r in iv.cost_regression_multi(df).collect()}
    for acct in (1, 2):
        sub = [r for r in rows if r[0] == acct]
        X = np.array([[1.0, r[2], r[3], r[4]] for r in sub])
        yv = np.array([r[5] for r in sub])
        beta = np.linalg.lstsq(X, yv, rcond=None)[0]
        g = got[acct]
        assert [g.intercept, g.coef_n_transactions, g.coef_n_active_cards, g.coef_tx_volume_usd] == \
            pytest.approx(list(beta), rel=1e-6, abs=1e-6)
        assert g.n_periods == 12 and 0.9 < g.r_squared <= 1.0
