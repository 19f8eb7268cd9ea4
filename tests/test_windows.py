"""Interval join, EWMA scan, windows of a stream, and loads with rejects."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import campaigns, ewma, intervals
from ledgerlens.sources import quarantine
from ledgerlens.streaming import sessions

DAY0 = dt.datetime(2024, 1, 1)


# ------------------------------------------------------------ interval join
@pytest.mark.parametrize("inclusive", [True, False])
def test_interval_join_equals_all_pairs(spark, inclusive):
    rnd = random.Random(3)
    minute = lambda n: DAY0 + dt.timedelta(minutes=n)
    points = [(i, rnd.choice(["a", "a", "b", None]), minute(rnd.randrange(-2000, 40000))) for i in range(300)]
    spans = []
    for i in range(60):
        s = rnd.randrange(-3000, 40000)
        spans.append((rnd.choice(["a", "b"]), minute(s), minute(s + rnd.choice([0, 1, 7, 64, 1440, 20000, 50000])), f"w{i}"))
    spans += [("a", minute(9), minute(3), "backwards"), (None, minute(0), minute(9), "no key"), ("a", None, minute(1), "no start")]
    points += [(1000, "a", spans[0][2]), (1001, "a", None), (1002, "a", minute(5)), (1002, "a", minute(5))]
    p = spark.createDataFrame(points, "`a.b` int, k string, ts timestamp_ntz")
    w = spark.createDataFrame(spans, "k string, start timestamp_ntz, end timestamp_ntz, name string")
    out = intervals.interval_join(p, w, ["k"], "ts", "start", "end", ["name"], inclusive)
    assert out.columns == ["a.b", "k", "ts", "name"]
    inside = lambda s, t, e: s <= t <= e if inclusive else s <= t < e
    want = [(i, k, t, name) for i, k, t in points for k2, s, e, name in spans
            if k is not None and k == k2 and t is not None and s is not None and inside(s, t, e)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert intervals.interval_join(p, w.limit(0), ["k"], "ts", "start", "end", ["name"]).count() == 0
    days = spark.createDataFrame([("a", dt.date(2024, 1, 3))], "k string, d date")
    got = intervals.interval_join(days, spark.createDataFrame([("a", dt.date(2024, 1, 1), dt.date(2024, 1, 3), "x")],
                                                              "k string, s date, e date, name string"), ["k"], "d", "s", "e", ["name"])
    assert got.count() == 1


# ----------------------------------------------------------------- EWMA scan
def test_ewma_scan_of_one_long_series_equals_pandas(spark):
    n = 120_000
    hours = spark.range(n).select(F.timestamp_seconds(F.col("id") * 3600 + 1_000_000_000).alias("ts"),
                                  (F.xxhash64("id") % 1000 / 7).alias("v"))
    got = ewma.ewma_scan(hours, "v", "ts").orderBy("ts").toPandas()
    s = pd.Series(got["v"])
    exp = s.ewm(span=7, adjust=True).mean()
    assert len(got) == n and np.allclose(got["ewm"], exp, rtol=1e-9, atol=1e-9)
    assert np.allclose(got["rolling_std"], (s - exp).rolling(7, min_periods=1).std().fillna(0), rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize(("span", "bucket"), [(1, "month"), (7, "day"), (30, "year")])
def test_ewma_scan_by_key(spark, span, bucket):
    rnd = random.Random(span)
    rows = [(k, dt.date(2023, 12, 20) + dt.timedelta(d), rnd.choice([1.5, -2.0, 8.25])) for k in (None, "a", "b") for d in range(70)
            if rnd.random() < 0.8]
    df = spark.createDataFrame([*rows, ("a", None, 1.0)], "k string, date date, v double")
    got = ewma.ewma_scan(df, "v", keys=("k",), span=span, bucket=bucket).toPandas()
    assert len(got) == len(rows)
    for k in (None, "a", "b"):
        own = sorted((d, v) for key, d, v in rows if key == k)
        exp = pd.Series([v for _, v in own]).ewm(span=span, adjust=True).mean()
        part = got[got["k"].isna()] if k is None else got[got["k"] == k]
        part = part.sort_values("date")
        assert [d for d, _ in own] == list(part["date"])
        assert np.allclose(part["ewm"], exp, rtol=1e-9)
    assert ewma.ewma_scan(df.limit(0), "v", keys=("k",)).count() == 0


# ---------------------------------------------------------- stream of windows
def _spend(rnd):
    days = sorted(rnd.sample(range(0, 300), 60)) + [400]
    return [(DAY0.date() + dt.timedelta(d), rnd.choice(["x", "y"]), float(rnd.randrange(1, 90))) for d in days for _ in range(2)]


def test_streamed_windows_equal_the_batch_after_a_restart(spark, tmp_path):
    rnd = random.Random(9)
    rows = _spend(rnd)
    rnd.shuffle(rows)
    schema = "date date, k string, amount_usd double"
    parts = [rows[i::6] for i in range(6)] + [[(dt.date(2050, 1, 1), k, 0.0)] for k in "xy"]
    src, target, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    emitted = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = sessions.start_session_windows(stream, target, state, delay="400 days", keys=("k",))
        q.awaitTermination()        # each file is a run of its own from the same checkpoint
        emitted.append(sessions.closed_windows(spark, target, ("k",)).count() if k == len(parts) - 1 else None)
    got = sessions.closed_windows(spark, target, ("k",))
    want = campaigns.detect_campaigns(spark.createDataFrame(rows, schema), 7, keys=("k",), value="amount_usd")
    cols = ["k", "campaign_id", "start", "end", "total_spend_usd"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    batch = sessions.session_windows(spark.createDataFrame(rows, schema), 7, keys=("k",))
    assert sorted(map(tuple, batch.collect())) == sorted((r["k"], r["start"], r["end"], r["total_spend_usd"]) for r in want.collect())


# --------------------------------------------------------------- rejected rows
def test_loaded_and_rejected_records_are_all_records(spark, tmp_path):
    head = "id,date,postedDate,type,amount,merchantName,authorizationStatus,currency,cardholderEmail"
    good = ["1,2026-02-15,,spend,-99.00,FACEBK ADS,approved,usd,x", '2,2026-02-16,,spend,"-7.5","DL, GOOGLE ADS",approved,usd,x']
    bad = {"3,2026-02-30,,spend,-1,SHOP,a,usd,x": ["date not a date"], "4,2026-02-15,,spend,12.x,SHOP,a,usd,x": ["amount not a decimal"],
           ",2026-02-15,,spend,,SHOP,a,usd,x": ["id missing", "amount missing"], "6,2026-02-15": ["columns"],
           "7,2026-02-15,,spend,-1,SHOP,a,usd,x,more": ["columns"], "8,2026-02-15T10:00,,spend,-1.001,SHOP,a,usd,x":
           ["date not a date", "amount not a decimal"], "9,2026-02-15,,spend,-1, ,a,usd,x": ["merchantName missing"]}
    (tmp_path / "a.csv").write_text("\n".join([head, *good, *bad]))
    (tmp_path / "b.csv").write_text(head + "\n")
    rows, rejects = quarantine.read_expenses_checked(spark, str(tmp_path))
    assert sorted((r["id"], str(r["date"]), float(r["amount"]), r["merchantName"]) for r in rows.collect()) == [
        ("1", "2026-02-15", -99.0, "FACEBK ADS"), ("2", "2026-02-16", -7.5, "DL, GOOGLE ADS")]
    got = rejects.collect()
    assert sorted(map(sorted, (r["reasons"] for r in got))) == sorted(map(sorted, bad.values()))
    assert all(r["file"].endswith("a.csv") and r["split_start"] == 0 for r in got)
    assert {r["record"] for r in got if r["reasons"] == ["columns"]} == {k for k, v in bad.items() if v == ["columns"]}
    assert rows.count() + rejects.count() == len(good) + len(bad)
    assert {r["reason"]: r["n_records"] for r in quarantine.reject_summary(rejects).collect()}["columns"] == 2


def test_levels_of_intervals_are_few(spark):
    """Each level copies all points: windows of 30 to 200 days share one."""
    days = spark.range(1, 5000).select((F.col("id") * 86_400_000_000 + 1).alias("n"))
    got = days.select("n", intervals.level(F.col("n")).alias("l")).collect()
    assert {r["l"] for r in got if 30 * 86_400_000_000 < r["n"] <= 200 * 86_400_000_000} == {44}
    assert all(r["n"] < 2 ** r["l"] <= 16 * r["n"] for r in got)
