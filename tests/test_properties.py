"""Property tests (hypothesis): distributed exact percentiles and the global
prefix equal their single-machine definitions on arbitrary inputs."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.functions.quantiles import exact_percentiles
from ledgerlens.operators import series

values = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-50, 50)), min_size=1, max_size=120)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=values, p=st.sampled_from([0.0, 0.1, 0.33, 0.5, 0.8, 0.99, 1.0]), acc=st.sampled_from([2, 10, 10_000]))
def test_percentile_property(spark, rows, p, acc):
    df = spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, v double")
    got = {r.k: r.q for r in exact_percentiles(df, "v", {"q": p}, ["k"], bound=acc).collect()}
    for k in {k for k, _ in rows}:
        exp = np.quantile([float(v) for kk, v in rows if kk == k], p)
        assert got[k] == pytest.approx(exp, abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.integers(1, 1000), min_size=1, max_size=200))
def test_prefix_property(spark, vals):
    df = spark.createDataFrame([(i, v / 100.0) for i, v in enumerate(vals)], "user_id long, net_revenue_usd double")
    got = series.ordered_prefix(df, "net_revenue_usd", "user_id", "net_revenue_usd", num_partitions=3).collect()
    pdf = pd.DataFrame({"user_id": range(len(vals)), "v": [v for v in vals]})
    pdf = pdf.sort_values(["v", "user_id"], ascending=[False, True]).reset_index(drop=True)
    pdf["rank"] = range(1, len(pdf) + 1)
    pdf["cum"] = (pdf["v"] * 10_000).cumsum()   # value/100 * 1e6 units
    exp = {int(r.user_id): (int(r.rank), int(r.cum)) for r in pdf.itertuples()}
    assert {r.user_id: (r.rank, r.cum_units) for r in got} == exp
