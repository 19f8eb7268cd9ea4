"""Segments (champion / active / at risk / dormant), founder and referral views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import dbl, r6, safe_div
from ..functions.quantiles import exact_percentiles

# Fixed values of the segmentation rule.
CHAMPION_PERCENTILE = 0.80
ACTIVE_DAYS = 30
AT_RISK_DAYS_MAX = 90
SEGMENTS = ("champion", "active", "at_risk", "dormant")


def classify_segments(master: DataFrame, revenue: str = "net_revenue_usd",
                      days: str = "days_since_last_active") -> DataFrame:
    """Threshold = exact 80th percentile of revenue over all users (a one-row
    frame, broadcast); then a when-ladder on recency and revenue."""
    thr = exact_percentiles(master, revenue, {"_thr": CHAMPION_PERCENTILE}, materialize=True)
    j = master.crossJoin(F.broadcast(thr))
    d = F.col(days)
    rev = dbl(revenue)
    seg = (F.when((d <= ACTIVE_DAYS) & (rev >= F.col("_thr")), "champion")
           .when((d <= ACTIVE_DAYS) & (rev < F.col("_thr")), "active")
           .when((d > ACTIVE_DAYS) & (d <= AT_RISK_DAYS_MAX), "at_risk")
           .otherwise("dormant"))
    return j.withColumn("segment", seg).drop("_thr")


def segment_summary(classified: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    g = classified.groupBy("segment").agg(
        F.count("user_id").alias("n_users"),
        r6(safe_div(F.sum("net_revenue_usd"), F.count("net_revenue_usd"))).alias("avg_net_revenue_usd"),
        dbl(F.sum("net_revenue_usd")).alias("total_net_revenue_usd"))
    # Share of users: the window is over at most four segment rows.
    return g.withColumn("pct_users", r6(safe_div("n_users", F.sum("n_users").over(Window.partitionBy()))))


def founders_vs_non_founders(master: DataFrame) -> DataFrame:
    tr = F.col("net_revenue_usd") > 0
    g = master.groupBy("is_founder").agg(
        F.count("user_id").alias("n_users"),
        r6(safe_div(F.sum("net_revenue_usd"), F.count("net_revenue_usd"))).alias("avg_net_revenue_usd"),
        r6(safe_div(F.count_if(tr), F.count(F.lit(1)))).alias("pct_transacting"))
    med = exact_percentiles(master, "net_revenue_usd", {"median_net_revenue_usd": 0.5}, ["is_founder"],
                           materialize=True)
    return g.join(med, ["is_founder"], "left").withColumn("median_net_revenue_usd", r6("median_net_revenue_usd"))


def referral_performance(classified: DataFrame) -> DataFrame:
    c = classified.where(F.col("referral_code").isNotNull() & (F.col("referral_code") != ""))
    g = c.groupBy("referral_code").agg(
        F.count("user_id").alias("n_users"),
        (F.sum("net_revenue_usd") / F.count("net_revenue_usd")).alias("_avg"),
        F.min("commission_rate_bps").alias("commission_rate_bps"),
        *[F.count_if(F.col("segment") == s).alias(f"_n_{s}") for s in SEGMENTS])
    avg = dbl("_avg")
    comm = F.greatest(avg * dbl("commission_rate_bps") / F.lit(10000.0), F.lit(0.0))
    return g.select("referral_code", "n_users", r6(avg).alias("avg_revenue"), "commission_rate_bps",
                    r6(comm).alias("commission_cost_usd"), r6(avg - comm).alias("net_value_usd"),
                    *[r6(safe_div(f"_n_{s}", "n_users")).alias(f"pct_{s}") for s in SEGMENTS])


def adoption_by_segment(classified: DataFrame, adoption: DataFrame,
                        products=("has_conversion", "has_card", "has_swap", "has_crossborder")) -> DataFrame:
    """Segment x product share, joined on the full user id (masking comes last)."""
    j = classified.select("user_id", "segment").join(adoption, "user_id")
    return j.groupBy("segment").agg(*[r6(F.avg(F.col(p).cast("double"))).alias(p) for p in products])
