"""Bounds at as_of, invoice gaps, empty inputs, null keys, ties, and the
shared checkpoint folder."""

import datetime as dt
import inspect

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.quantiles import exact_percentiles
from ledgerlens.operators import campaigns, ramp, revenue, scan, series, users
from ledgerlens.session import local_scratch
from ledgerlens.streaming.ingest import start_spend_ingest

AS_OF = "2024-03-10 12:00:00"


def _at(*xs):
    return dt.datetime(2024, 3, *xs)


def test_signups_and_activity_end_at_as_of(spark):
    u = spark.createDataFrame(
        [(1, _at(9, 11), _at(10, 11), "ok"), (2, _at(9, 13), _at(10, 12), "ok"), (3, _at(10, 12), _at(20), "ok"),
         (4, _at(11), _at(5), "suspended"), (5, _at(10, 11), _at(5), "ok")],
        "id int, created_at timestamp_ntz, last_active_at timestamp_ntz, status string")
    assert users.signups_24h(u, AS_OF).first()[0] == 2
    assert tuple(users.activity_kpis(u, AS_OF).first()) == (1, 2, 2)


def _events(spark, rows):
    return spark.createDataFrame(rows, "id int, created_at timestamp_ntz, direction string, side string, k int, "
                                       "from_amount_usdc double, to_amount_usdc double, effective_rate double")


def test_position_of_an_empty_table_is_empty(spark):
    assert scan.position_pnl(_events(spark, []), num_partitions=3).count() == 0
    assert scan.position_pnl(_events(spark, []), keys=("k",), num_partitions=3).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_null_keys_are_one_position(spark, parts):
    rows = [(i, _at(1 + i % 9, i % 24), "usdc_to_brl", "offramp", k, 10.0, 0.0, 5.0) for i in range(40) for k in (None, 1)]
    out = scan.position_pnl(_events(spark, rows), keys=("k",), num_partitions=parts).groupBy("k").agg(
        F.max("position_qty_usdc").alias("q")).collect()
    assert {r["k"]: float(r["q"]) for r in out} == {None: 400.0, 1: 400.0}


def test_top_decile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "user_id string, net_revenue_usd double")
    assert tuple(series.top_decile_share(empty).first()) == (0, 0, 0.0)


def test_percentile_with_one_value_in_most_rows(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(F.lit(7000.0)).alias("v"))
    pdf = df.toPandas()["v"]
    got = exact_percentiles(df, "v", {"a": 0.02, "b": 0.5, "c": 0.97}, bound=100).first()
    assert tuple(got) == pytest.approx(tuple(pdf.quantile([0.02, 0.5, 0.97])))


def test_active_daily_counts_users_once_and_skips_nulls(spark):
    day = _at(1, 1)
    a = spark.createDataFrame([("u", day), ("u", day), (None, day), ("v", day)], "user_id string, created_at timestamp_ntz")
    b = spark.createDataFrame([("u", day)], "user_id string, created_at timestamp_ntz")
    row = ramp.active_daily({"deposits": a, "transfers": b}).first()
    assert tuple(row)[1:] == (2, 2, 1)


def test_unit_cost_falls_back_to_an_earlier_invoice(spark):
    inv = spark.createDataFrame([("2024-01", 100.0, 50), ("2024-04", 90.0, 30)],
                                "period string, invoice_total_usd double, n_transactions long")
    costs = {r[0]: float(r[1]) for r in campaigns.unit_cost_by_period(inv).collect()}
    assert list(costs.values()) == [2.0, 3.0]


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError):
        local_scratch("yarn")
    assert local_scratch("local[4]")


def test_a_stream_needs_its_checkpoint_folder():
    assert inspect.signature(start_spend_ingest).parameters["checkpoint_location"].default is inspect.Parameter.empty


def test_swaps_can_be_left_out_of_daily_revenue(spark):
    assert "swaps_enabled" in inspect.signature(revenue.daily_revenue_by_product).parameters
