"""Exact percentiles (linear interpolation) by counting selection in constant memory.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer; for a global or heavily skewed group that is unbounded.  Here a
wanted rank is closed in on instead:

1. one aggregate gives count, least and greatest value of every group: the first
   band of each wanted rank;
2. while a band holds more than ``bound`` rows and more than one value, a pass counts
   the rows of its ``SUB_BANDS`` equal sub-bands (map-side first, so a task sends at
   most that many rows for a band), and the band becomes the sub-band that
   holds the rank, tightened to the least and greatest value in it.  Sub-bands are
   equal in the logarithm first and in the value then, by turns, so that long
   tails and narrow bodies both shrink;
3. the distinct values of the last bands, at most ``bound`` for each, are ranked by
   running counts, and the two neighbours of a rank are interpolated.

A task sees at most ``max(bound, SUB_BANDS)`` rows of a band, whatever the number of
rows.  Ranks that share a band are counted once.  The loop asks the driver for one
number a pass; a group of up to ``bound`` rows needs no pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table

#: Rows up to which a band is ranked at once, and sub-bands of a counting pass.
BOUND = 50_000
SUB_BANDS = 4096
#: Infinities count as the largest finite values.
LARGEST = 1.7e308


def _place(v: Column, lo: Column, hi: Column, log: bool) -> Column:
    """Number (from 1) of the sub-band of ``v`` in the band from ``lo`` to ``hi``;
    never smaller for a larger value."""
    def f(x: Column) -> Column:
        # The least positive value has a logarithm over -745.
        return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 745)) if log else x / 4
    width = F.width_bucket(f(v), f(lo), f(hi), F.lit(SUB_BANDS))
    # Distinct values may have the same logarithm, or too little between them.
    return F.coalesce(F.when(f(lo) < f(hi), width), F.when(v <= lo, F.lit(1)).when(v >= hi, F.lit(SUB_BANDS + 1)).otherwise(F.lit(2))).cast("int")


def _with(base: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``base`` with the columns of the bands of their group."""
    if keys:
        return base.join(bands, [base[k].eqNullSafe(bands[f"_k_{k}"]) for k in keys])
    # One band for each wanted rank at most: a bound that no data moves.
    return base.join(F.broadcast(bands), F.lit(True))


def rank_bands(base: DataFrame, keys: list[str], fractions: list[float], bound: int = BOUND) -> DataFrame:
    """The bands of the two ranks next to each fraction: _k_<key>, _n (rows of the
    group), _rank (from 0), _below (rows under the band), _lo, _hi, _in (rows in the
    band).  ``base`` has the keys and ``_v``; a band holds at most ``bound`` rows or
    one value."""
    groups = base.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    lower = [F.floor((F.col("_n") - 1).cast("double") * F.lit(float(p))).cast("long") for p in fractions]
    ranks = F.array_distinct(F.array(*lower, *[F.least(r + 1, F.col("_n") - 1) for r in lower]))
    named = [f"_k_{k}" for k in keys]
    state = groups.select(*named, "_n", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"),
                          "_lo", "_hi", F.col("_n").alias("_in"))
    log = True
    while True:
        state = written_table(state, "rank-bands")
        wide = (F.col("_in") > bound) & (F.col("_lo") < F.col("_hi"))
        if not state.where(wide).limit(1).count():
            return state
        bands = state.where(wide).select(*named, "_lo", "_hi").distinct()
        rows = _with(base, bands, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        counted = rows.groupBy(*named, "_lo", "_hi", _place(F.col("_v"), F.col("_lo"), F.col("_hi"), log).alias("_sub")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_sub_lo"), F.max("_v").alias("_sub_hi"))
        order = Window.partitionBy(*named, "_lo", "_hi").orderBy("_sub").rowsBetween(Window.unboundedPreceding, 0)
        ends = counted.select(*[F.col(c).alias(f"c{c}") for c in [*named, "_lo", "_hi"]], "_c", "_sub_lo", "_sub_hi",
                              F.sum("_c").over(order).alias("_end"))
        same = [F.col(c).eqNullSafe(F.col(f"c{c}")) for c in [*named, "_lo", "_hi"]]
        at = F.col("_rank") - F.col("_below")
        narrow = state.where(wide).join(ends, same).where((at < F.col("_end")) & (at >= F.col("_end") - F.col("_c")))
        state = state.where(~wide).unionByName(narrow.select(
            *named, "_n", "_rank", (F.col("_below") + F.col("_end") - F.col("_c")).alias("_below"),
            F.col("_sub_lo").alias("_lo"), F.col("_sub_hi").alias("_hi"), F.col("_c").alias("_in")))
        log = not log


def exact_percentiles(df: DataFrame, value: str | Column, ps: dict[str, float],
                      keys: list[str] | tuple[str, ...] = (), accuracy: int = 10_000,
                      materialize: bool = False, exact: bool = True, bound: int = BOUND) -> DataFrame:
    """One row per group of ``keys`` with one DOUBLE column per entry of ``ps``
    (name -> fraction in [0, 1]).  Nulls and NaN are ignored; a group without
    values has no row, and without keys an empty table gives one row of nulls.

    The (keys, value) projection is read by several passes.  With
    ``materialize`` it is written once to the shared checkpoint folder so
    an expensive input plan (e.g. the per-user master) is not re-run per pass.
    ``exact=False`` returns ``percentile_approx`` values of that ``accuracy`` instead
    (one pass)."""
    keys = list(keys)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    finite = F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, F.lit(LARGEST)), F.lit(-LARGEST)))
    base = df.select(*keys, finite.alias("_v")).where(F.col("_v").isNotNull())
    if exact is False:
        # Approximate mode: one map-side-combined sketch per group.
        return base.groupBy(*keys).agg(*[F.percentile_approx("_v", F.lit(float(p)), accuracy).cast("double")
                                             .alias(n) for n, p in ps.items()])
    if materialize:
        base = written_table(base, "ranked-values")
    state = rank_bands(base, keys, list(ps.values()), bound)
    named = [f"_k_{k}" for k in keys]
    # A band of one value is its value; the others are ranked by running counts.
    done = state.where("_lo = _hi").select(*named, "_n", "_rank", F.col("_lo").alias("_x"))
    bands = state.where("_lo < _hi").select(*named, "_lo", "_hi", "_below").distinct()
    inside = _with(base, bands, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    counted = inside.groupBy(*named, "_lo", "_hi", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*named, "_lo", "_hi", "_below").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.select(*[F.col(c).alias(f"c{c}") for c in [*named, "_lo", "_hi", "_below"]], "_v", "_c",
                          F.sum("_c").over(order).alias("_end"))
    at = F.col("_rank") - F.col("_below")
    ranked = state.where("_lo < _hi").join(
        ends, [F.col(c).eqNullSafe(F.col(f"c{c}")) for c in [*named, "_lo", "_hi", "_below"]])
    found = done.unionByName(ranked.where((at < F.col("_end")) & (at >= F.col("_end") - F.col("_c")))
                             .select(*named, "_n", "_rank", F.col("_v").alias("_x")))
    picked = found.groupBy(*named).agg(F.first("_n").alias("_n"), F.map_from_entries(
        F.collect_list(F.struct("_rank", "_x"))).alias("_at"))  # two entries for each fraction at most
    out = []
    for name, p in ps.items():
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        k = F.floor(pos)
        a, c = (F.try_element_at("_at", r.cast("long")) for r in (k, F.least(k + 1, F.col("_n") - 1)))
        out.append(F.when(pos == k, a).otherwise(a + (pos - k) * (c - a)).alias(name))
    return picked.select(*[F.col(f"_k_{k}").alias(k) for k in keys], *out)


def exact_percentile_col(df: DataFrame, value: str, p: float, name: str = "pct") -> DataFrame:
    """Global percentile as a one-row frame (for a broadcast threshold)."""
    return exact_percentiles(df, value, {name: p})
