"""Counting selection of exact percentiles: equal to NumPy, in bounded bands."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import quantiles
from ledgerlens.functions.quantiles import exact_percentiles, rank_bands

PS = {"lo": 0.001, "q1": 0.25, "m": 0.5, "p90": 0.9, "hi": 0.9999}


def numbers(spark, n, kind):
    u = (F.xxhash64("id") / F.lit(2.0 ** 64)) + 0.5
    v = {"uniform": u * 1000, "signed": (u - 0.5) ** 3, "long_tail": F.exp(F.tan((u - 0.5) * 3.1)),
         "extreme": F.when(F.col("id") % 2 == 0, F.pow(F.lit(10.0), u * 600 - 300)).otherwise(-u)}[kind]
    return spark.range(n).select(v.cast("double").alias("v"), (F.col("id") % 3).alias("k"))


@pytest.mark.parametrize("kind", ["uniform", "signed", "long_tail", "extreme"])
def test_percentiles_of_many_distinct_values_equal_numpy(spark, kind):
    n = 1_000_000 if kind == "uniform" else 60_000
    df = numbers(spark, n, kind).cache()
    values = np.array([r[0] for r in df.select("v").collect()]) if n < 100_000 else df.select("v").toPandas()["v"].to_numpy()
    got = exact_percentiles(df, "v", PS, bound=1000).first()
    want = np.quantile(values, list(PS.values()))
    assert list(got) == pytest.approx(list(want), rel=1e-9, abs=1e-300)
    df.unpersist()


@pytest.mark.parametrize("n", [10_000, 300_000])
def test_the_last_bands_do_not_grow_with_the_rows(spark, n):
    base = numbers(spark, n, "long_tail").withColumnRenamed("v", "_v")
    bands = rank_bands(base, ["k"], list(PS.values()), bound=500).collect()
    assert {r["_k_k"] for r in bands} == {0, 1, 2}
    assert all(r["_in"] <= 500 or r["_lo"] == r["_hi"] for r in bands)
    assert all(r["_below"] <= r["_rank"] < r["_below"] + r["_in"] for r in bands)


def test_groups_with_ties_nulls_and_odd_values(spark):
    rows = [("ties", 5.0)] * 3000 + [("ties", float(i)) for i in range(100)] + [(None, 1.0), (None, 2.0), ("none", None)]
    rows += [("odd", x) for x in (math.inf, -math.inf, math.nan, 0.0, -0.0, 1.5)] + [("one", 7.25)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: r["m"] for r in exact_percentiles(df, "v", {"m": 0.5}, ["k"], bound=10).collect()}
    assert got == {"ties": 5.0, None: 1.5, "odd": 0.0, "one": 7.25}
    none = spark.createDataFrame([], "k string, v double")
    assert exact_percentiles(none, "v", {"m": 0.5}, ["k"]).count() == 0
    assert tuple(exact_percentiles(none, "v", {"m": 0.5, "x": 1.0}).first()) == (None, None)


def test_neighbours_in_floating_point_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SUB_BANDS", 4)
    x, values = 1e9, []
    for _ in range(400):
        values.append(x)
        x = math.nextafter(x, math.inf)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_percentiles(df, "v", {"a": 0.0, "m": 100 / 399, "z": 1.0}, bound=2).first()
    assert (got["a"], got["m"], got["z"]) == (values[0], values[100], values[-1])
