"""Loads that do not start over: id table, activity bitmaps, inventory closings; and
the as-of join by key."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import activity, asof, cohort_store, inventory, scan
from ledgerlens.sources import sinks
from ledgerlens.sources.id_table import IdTable

ROWS = "id string, v int"


def _ids(spark, lo, hi, v=0):
    return spark.range(lo, hi).select(F.format_string("%08d", "id").alias("id"), F.lit(v).alias("v"))


# ------------------------------------------------------------- id table
def test_files_read_do_not_grow_with_the_table(spark, tmp_path):
    t = IdTable(spark, str(tmp_path / "t"))
    read = []
    for k in range(5):
        assert t.load(_ids(spark, k * 1000, k * 1000 + 1000), files=3) == (1000, 0)
        read.append((t.held(_ids(spark, 90_000, 90_500).select("id"))[1], t.held(_ids(spark, 100, 110).select("id"))))
    assert t.manifest().count() == 15 and t.read().count() == 5000
    assert all(files == [] for files, _ in read)
    assert all(len(files) == 1 and held.count() == 10 for _, (held, files) in read)
    # Ids between those of a file: the filter keeps nearly all files out.
    gaps = spark.createDataFrame([(f"{i:08d}x",) for i in range(0, 5000, 500)], "id string")
    held, files = t.held(gaps)
    assert held.count() == 0 and len(files) <= 1


def test_a_batch_adds_new_ids_once(spark, tmp_path):
    t = IdTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.version() == 0
    rows = [("a", 2), ("a", 1), ("b", 5), (None, 7), (None, 8)]
    assert t.load(spark.createDataFrame(rows, ROWS), tag="one") == (2, 3)
    assert t.load(spark.createDataFrame(rows, ROWS)) == (0, 5)
    assert t.load(spark.createDataFrame([("c", 9)], ROWS), tag="one") == (0, 1)
    assert t.load(spark.createDataFrame([("b", 6), ("c", 9)], ROWS), tag="two") == (1, 1)
    assert t.load(spark.createDataFrame([], ROWS)) == (0, 0)
    want = [("a", 1), ("b", 5), ("c", 9)]
    assert sorted(map(tuple, t.read().collect())) == want
    assert t.version() == 2 and sorted(map(tuple, t.read(1).collect())) == want[:2]
    assert t.compact(files=1) == 3 and t.manifest().count() == 1 and sorted(map(tuple, t.read().collect())) == want
    assert t.load(spark.createDataFrame([("a", 3)], ROWS)) == (0, 1)


def test_a_killed_load_leaves_no_rows_and_can_be_run_again(spark, tmp_path):
    t = IdTable(spark, str(tmp_path / "t"))
    t.load(_ids(spark, 0, 10))

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        t.load(_ids(spark, 5, 20, 1), before_publish=killed)
    assert t.version() == 1 and t.read().count() == 10
    assert t.load(_ids(spark, 5, 20, 1)) == (10, 5)
    assert t.read().agg(F.sum("v")).first()[0] == 10


def test_the_second_of_two_loads_at_once_fails_whole(spark, tmp_path):
    t = IdTable(spark, str(tmp_path / "t"))
    t.load(_ids(spark, 0, 10))
    with pytest.raises(RuntimeError, match="published by another load"):
        t.load(_ids(spark, 10, 20), before_publish=lambda: t.load(_ids(spark, 20, 25)))
    assert t.version() == 2 and t.read().count() == 15
    assert t.load(_ids(spark, 10, 20)) == (10, 0)


def test_a_folder_of_plain_files_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    _ids(spark, 0, 10).write.parquet(path)
    assert sinks.append_new_rows(_ids(spark, 5, 15), path) == (5, 5)
    assert IdTable(spark, path).read().count() == 15
    typed = spark.createDataFrame([(1, "x"), (1, "y"), (12, "z")], "key long, note string")
    assert sinks.append_new_rows(typed, str(tmp_path / "u"), "key") == (2, 1)
    assert sorted(map(tuple, IdTable(spark, str(tmp_path / "u"), "key").read().collect())) == [(1, "x"), (12, "z")]


# ------------------------------------------------------------- bitmaps
def test_bitmaps_count_like_sets_and_merge(spark):
    rnd = random.Random(2)
    day0 = dt.date(2024, 1, 1)
    facts = [(f"u{rnd.randrange(60)}", day0 + dt.timedelta(rnd.choice([0, 1, 2, 3, 9, 10, 40, 41, 75]))) for _ in range(300)]
    facts += [("late", day0), ("late", day0 + dt.timedelta(75))]
    frame = lambda rows: spark.createDataFrame(rows, "user_id string, activity_date date")
    first, second = frame(facts[:150] + [(None, day0), ("u1", None)]), frame(facts[150:])
    known = activity.user_numbers(first)
    numbers = activity.user_numbers(second, known)
    old = {r["user"]: r["n"] for r in known.collect()}
    new = {r["user"]: r["n"] for r in numbers.collect()}
    assert old.items() <= new.items() and len(set(new.values())) == len(new) == len({u for u, _ in facts})
    bits = activity.merge_bitmaps(activity.daily_bitmaps(first, known), activity.daily_bitmaps(second, numbers))
    got = {r["date"]: (r["d"], r["w"], r["m"]) for r in activity.rolling_active(bits, {"d": 1, "w": 7, "m": 30}).collect()}
    days = [day0 + dt.timedelta(i) for i in range(76)]
    assert got == {d: tuple(len({u for u, x in facts if 0 <= (d - x).days < n}) for n in (1, 7, 30)) for d in days}
    month = lambda d: d.replace(day=1)
    sets = {}
    for u, d in facts:
        sets.setdefault(month(d), set()).add(u)
    assert {r["period"]: r["active_users"] for r in activity.active_by_period(bits, "M").collect()} == {
        k: len(v) for k, v in sets.items()}
    back = {r["period"]: (r["active_users"], r["returning_users"]) for r in activity.returning_by_period(bits, "M").collect()}
    before = lambda d: month(d - dt.timedelta(1))
    assert back == {k: (len(v), len(v & sets.get(before(k), set()))) for k, v in sets.items()}
    none = activity.daily_bitmaps(frame([]), numbers)
    assert activity.rolling_active(none, {"d": 1}).count() == 0


# -------------------------------------------------------------- as-of join
@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_asof_join_equals_a_search_per_row(spark, bucket):
    rnd = random.Random(7)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rates = [(k, at(rnd.randrange(200_000)), float(i)) for i, k in enumerate(rnd.choices("aaab", k=120))]
    rates += [("a", at(500), -1.0), ("a", at(500), 99.5), (None, at(1), 5.0), ("b", None, 6.0)]
    facts = [(i, rnd.choice("aaaabc"), at(rnd.randrange(250_000))) for i in range(400)]
    facts += [(900, "a", at(500)), (901, None, at(9)), (902, "a", None), (903, "b", at(-5)), (903, "b", at(-5))]
    f = spark.createDataFrame(facts, "`a.b` int, k string, ts timestamp_ntz")
    r = spark.createDataFrame(rates, "k string, since timestamp_ntz, rate double")
    by_key = {}
    for k, t, v in rates:
        if k is not None and t is not None:
            by_key.setdefault(k, []).append((t, v))

    def want(k, t, days=None, first=False):
        known = sorted(by_key.get(k, []))
        if t is None or not known:
            return None
        n = bisect.bisect_right([x for x, _ in known], t)
        if not n:
            return known[0][1] if first else None
        top = max(v for x, v in known if x == known[n - 1][0])
        return None if days and known[n - 1][0] < t - dt.timedelta(days) else top

    def got(**kw):
        out = asof.asof_join(f, r, ["k"], "ts", "since", ["rate"], bucket=bucket, **kw)
        assert out.columns == ["a.b", "k", "ts", "rate"]
        return sorted(map(tuple, out.collect()), key=repr)

    assert got() == sorted([(i, k, t, want(k, t)) for i, k, t in facts], key=repr)
    assert got(tolerance="INTERVAL 2 DAYS") == sorted([(i, k, t, want(k, t, 2)) for i, k, t in facts], key=repr)
    assert got(first_if_none=True) == sorted([(i, k, t, want(k, t, None, True)) for i, k, t in facts], key=repr)


def test_asof_join_has_no_inequality_join_and_takes_empty_sides(spark):
    f = spark.createDataFrame([(1, dt.date(2024, 1, 5))], "k int, d date")
    r = spark.createDataFrame([(1, dt.date(2024, 1, 1), 2.5)], "k int, since date, rate double")
    out = asof.asof_join(f, r, ["k"], "d", "since", ["rate"])
    assert out.first()["rate"] == 2.5
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert asof.asof_join(f, r.limit(0), ["k"], "d", "since", ["rate"]).first()["rate"] is None
    assert asof.asof_join(f.limit(0), r, ["k"], "d", "since", ["rate"]).count() == 0


# --------------------------------------------------------------- inventory
def _conv(spark, rows):
    return spark.createDataFrame(rows, "id int, created_at timestamp_ntz, direction string, side string, k int, "
                                       "from_amount_usdc double, to_amount_usdc double, effective_rate double")


def test_closings_load_by_load_equal_the_full_run(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(160):
        sell = rnd.random() < 0.5
        amount = float(rnd.randrange(1, 500)) / 8
        rows.append((i, dt.datetime(2024, 3, 1 + i // 14, rnd.randrange(24)), "brl_to_usdc" if sell else "usdc_to_brl",
                     "onramp" if sell else "offramp", rnd.choice([None, 1, 1, 1, 2]), 0.0 if sell else amount,
                     amount if sell else 0.0, 5 + rnd.randrange(100) / 100))
    late = [r for r in rows if r[0] % 17 == 3]
    on_time = [r for r in rows if r[0] % 17 != 3]
    for keys in (("k",), ("one",)):
        one = lambda rs: _conv(spark, rs).withColumn("one", F.lit(1))
        full = inventory.closings(scan.position_rows(one(rows), keys, num_partitions=3), keys)
        state = history = None
        sizes = []
        for part in ([r for r in on_time if r[1].day <= 5], [r for r in on_time if r[1].day == 6],
                     [r for r in on_time if r[1].day > 6], late):
            batch = one(part)
            state, restated = inventory.apply_load(state, history, batch, keys)
            sizes.append(restated.count())
            history = batch if history is None else history.unionByName(batch)
        got = {(r[keys[0]], r["day"]): (r["_q"], r["_avg"], r["_pnl_cum"]) for r in state.collect()}
        want = {(r[keys[0]], r["day"]): (r["_q"], r["_avg"], r["_pnl_cum"]) for r in full.collect()}
        assert got.keys() == want.keys()
        for key, (q, avg, cum) in want.items():
            assert got[key][0] == q and got[key][1] == (avg if avg is None else pytest.approx(avg, rel=1e-12))
            assert abs(got[key][2] - cum) <= 2 * len(rows)      # 1e-8 units
        # A load behind the stored days restates its own days only.
        assert sizes[1] == len({(r[4] if keys == ("k",) else 1, r[1].date()) for r in on_time if r[1].day == 6})


# ----------------------------------------------------------------- cohorts
def test_cells_change_only_for_cohorts_with_new_rows(spark):
    rnd = random.Random(8)
    base = [(u, dt.date(2024, 1 + u % 4, 3)) for u in range(40)] + [(90, None)]
    facts = [(rnd.randrange(42), dt.date(2024, rnd.randrange(1, 13), rnd.randrange(1, 28)), rnd.randrange(1, 50)) for _ in range(400)]
    facts += [(None, dt.date(2024, 5, 5), 3), (1, None, 4)]
    b = spark.createDataFrame(base, "user_id int, signup_date date")
    f = spark.createDataFrame(facts, "user_id int, ts date, amount long")
    months = lambda rows: cohort_store.user_months(rows, "ts", {"amount": F.col("amount")})
    full = cohort_store.cohort_cells(months(f), b)
    key = lambda df: sorted(map(tuple, df.collect()))
    first, second = f.where("month(ts) < 9 AND user_id % 7 <> 3"), f.where("month(ts) >= 9 OR user_id % 7 = 3 OR ts IS NULL OR user_id IS NULL")
    stored, cells, _ = cohort_store.apply_months(None, None, months(first), b)
    one = months(second.where("user_id % 4 = 2"))
    stored, cells2, again = cohort_store.apply_months(stored, cells, one, b)
    assert {r["signup_month"] for r in again.collect()} == {dt.date(2024, 3, 1)}
    untouched = F.col("signup_month") != F.lit("2024-03-01").cast("date")
    assert key(cells2.where(untouched)) == key(cells.where(untouched))
    stored, cells3, _ = cohort_store.apply_months(stored, cells2, months(second.where("user_id % 4 <> 2")), b)
    assert key(cells3) == key(full)
    report = cohort_store.retention_report(cells3, "amount").collect()
    assert all(0 < r["retention"] <= 1 for r in report)
    assert cohort_store.cohort_cells(months(f.limit(0)), b).count() == 0
