"""Windows joined to facts, windows of a stream, long series, and loads with rejects."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.money import dbl, rnd
from ..operators import campaigns as cp
from ..operators import ewma, intervals
from ..session import ensure_checkpoint_dir
from ..sources import quarantine, sinks
from ..sources.binding import Bound
from ..sources.files import EXPENSE_SCHEMA
from ..streaming import sessions
from .oracle_views import with_views
from .registry import query


def _r(x: str, d: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(30,10)), {d}) AS DOUBLE)"


def _folder(b: Bound, name: str) -> str:
    return f"{ensure_checkpoint_dir(b.spark).rstrip('/')}/files-{b.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------ windows and facts
_USER_WINDOWS = """
    user_windows AS (
      SELECT user_id, 'campaign_' || CAST(island AS VARCHAR) AS campaign_id, min("date") AS start, max("date") + 30 AS "end"
      FROM (SELECT *, sum(CASE WHEN prev IS NULL OR datediff('day', prev, "date") > 7 THEN 1 ELSE 0 END)
                          OVER (PARTITION BY user_id ORDER BY "date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
            FROM (SELECT *, lag("date") OVER (PARTITION BY user_id ORDER BY "date") AS prev FROM (
                    SELECT DISTINCT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS "date" FROM orders)))
      GROUP BY user_id, island)"""


@query("transactions_in_user_windows", with_views(f"""
    WITH {_USER_WINDOWS}
    SELECT w.user_id, w.campaign_id, count(*) AS n_transactions, CAST(sum(t.amount_usd_cents) AS BIGINT) AS amount_cents
    FROM user_windows w JOIN card_transactions t
      ON t.user_id = w.user_id AND CAST(t.posted_at AS TIMESTAMP) >= w.start AND CAST(t.posted_at AS TIMESTAMP) <= w."end"
    GROUP BY 1, 2""", "card_transactions"))
def _in_windows(b: Bound):
    """Card transactions within each user's own windows and the 30 days behind them (such
    windows overlap)."""
    o = b.table("orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("date"),
                                 F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    windows = cp.detect_campaigns(o, 7, keys=("user_id",), value="v").withColumn("end", F.date_add("end", 30))
    met = intervals.interval_join(b.card_transactions, windows, ["user_id"], "posted_at", "start", "end", ["campaign_id"])
    return met.groupBy("user_id", "campaign_id").agg(F.count(F.lit(1)).alias("n_transactions"),
                                                     F.sum("amount_usd_cents").alias("amount_cents"))


# ------------------------------------------------------- windows of a stream
@query("stream_campaign_windows", with_views("""
    SELECT campaign_id, start, "end", CAST(total_spend_usd AS DOUBLE) AS total_spend_usd FROM (
      SELECT 'campaign_' || CAST(island AS VARCHAR) AS campaign_id, min("date") AS start, max("date") AS "end", sum(v) AS total_spend_usd
      FROM (SELECT *, sum(CASE WHEN prev IS NULL OR datediff('day', prev, "date") > 7 THEN 1 ELSE 0 END)
                          OVER (ORDER BY "date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
            FROM (SELECT *, lag("date") OVER (ORDER BY "date") AS prev FROM (
                    SELECT "date", sum(CAST(abs(round(amount, 2)) AS DECIMAL(10,4))) AS v FROM expense_export
                    WHERE merchantName LIKE 'FACEBK%' OR lower(merchantName) LIKE '%google ads%' GROUP BY 1)))
      GROUP BY island)""", "expense_export"))
def _stream_windows(b: Bound):
    """The expense export replayed as a stream of files in no order of time.  A last
    file far in the future moves the watermark past all windows."""
    from ..streaming.ingest import spend_stream
    cents = F.round("amount", 2).cast("decimal(18,2)")
    e = b.expense_export
    out = e.select(*[cents.alias(f.name) if f.name == "amount" else F.col(f.name) if f.name in e.columns
                     else F.lit(None).cast("string").alias(f.name) for f in EXPENSE_SCHEMA.fields])
    source = _folder(b, "export")
    out.repartition(4, "id").write.mode("append").option("header", True).csv(source)
    end = out.agg(F.lit("end").alias("id"), F.date_add(F.max("date"), 20000).alias("date"), F.lit("FACEBK end").alias("merchantName"),
                  F.lit(0).cast("decimal(18,2)").alias("amount"))
    end.select(*[F.col(f.name) if f.name in end.columns else F.lit(None).cast("string").alias(f.name)
                 for f in EXPENSE_SCHEMA.fields]).write.mode("append").option("header", True).csv(source)
    target, state = _folder(b, "windows"), _folder(b, "stream")
    sessions.start_session_windows(spend_stream(b.spark, source), target, state, delay="10000 days").awaitTermination()
    return sessions.closed_windows(b.spark, target).withColumn("total_spend_usd", dbl("total_spend_usd"))


# ---------------------------------------------------------------- long series
@query("ewma_scan_by_account", with_views(f"""
    WITH d AS (SELECT account_id, "date", v, row_number() OVER (PARTITION BY account_id ORDER BY "date") AS rn
               FROM (SELECT l_suppkey AS account_id, CAST(l_shipdate AS DATE) AS "date", CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)),
         e AS (SELECT a.account_id, a."date", a.v, sum(b.v * pow(0.75, a.rn - b.rn)) / sum(pow(0.75, a.rn - b.rn)) AS ewm
               FROM d a JOIN d b ON b.account_id = a.account_id AND b.rn <= a.rn GROUP BY a.account_id, a."date", a.v, a.rn)
    SELECT account_id, "date", v AS n_lines, {_r('ewm', 6)} AS ewm, {_r('v - ewm', 6)} AS residual,
           {_r('coalesce(stddev_samp(v - ewm) OVER (PARTITION BY account_id ORDER BY "date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0)', 6)} AS rolling_std
    FROM e"""))
def _ewma_scan(b: Bound):
    d = b.table("lineitem").groupBy(F.col("l_suppkey").alias("account_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"))
    f = ewma.ewma_scan(d, "n_lines", keys=("account_id",))
    return f.select("account_id", "date", "n_lines", *[rnd(c, 6).alias(c) for c in ("ewm", "residual", "rolling_std")])


# -------------------------------------------------------------- rejected rows
@query("expense_load_rejects", with_views("""
    WITH e AS (SELECT CAST(id AS BIGINT) AS k FROM expense_export),
         r AS (SELECT k, 'columns' AS reason FROM e WHERE k % 83 = 0
               UNION ALL SELECT k, 'id missing' FROM e WHERE k % 79 = 0 AND k % 83 <> 0
               UNION ALL SELECT k, 'date not a date' FROM e WHERE k % 89 = 0 AND k % 83 <> 0
               UNION ALL SELECT k, 'amount not a decimal' FROM e WHERE k % 97 = 0 AND k % 83 <> 0)
    SELECT reason, count(*) AS n_records FROM r GROUP BY 1
    UNION ALL SELECT 'loaded', count(*) FROM e WHERE k NOT IN (SELECT k FROM r)""", "expense_export"))
def _rejects(b: Bound):
    """The export written as lines, some of them broken, and loaded: records by reason,
    and those that were loaded."""
    key = F.col("id").cast("bigint")
    fields = F.concat_ws(",", F.when(key % 79 == 0, "").otherwise(F.col("id")),
                         F.when(key % 89 == 0, "1996-13-45").otherwise(F.col("date").cast("string")), F.lit(""), F.lit(""),
                         F.when(key % 97 == 0, "n/a").otherwise(F.round("amount", 2).cast("decimal(18,2)").cast("string")),
                         F.col("merchantName"), F.lit(""), F.col("currency"), F.lit(""))
    line = F.when(key % 83 == 0, F.concat_ws(",", F.col("id"), F.col("merchantName"))).otherwise(fields)
    path = _folder(b, "lines")
    b.expense_export.select(line.alias("line")).write.text(path)
    rows, rejects = quarantine.read_expenses_checked(b.spark, path, header=False)
    loaded = rows.agg(F.lit("loaded").alias("reason"), F.count(F.lit(1)).alias("n_records"))
    return quarantine.reject_summary(rejects).unionByName(loaded)


@query("spend_of_checked_load", with_views("""
    SELECT "date", platform, CAST(sum(amount_usd) AS DOUBLE) AS amount_usd FROM (
      SELECT "date", CAST(abs(round(amount, 2)) AS DECIMAL(10,4)) AS amount_usd,
             CASE WHEN merchantName LIKE 'FACEBK%' THEN 'meta' WHEN lower(merchantName) LIKE '%google ads%' THEN 'google' END AS platform
      FROM expense_export) WHERE platform IS NOT NULL GROUP BY 1, 2""", "expense_export"))
def _checked_spend(b: Bound):
    """Daily spend from the checked load of a clean export."""
    e = b.expense_export
    cents = F.round("amount", 2).cast("decimal(18,2)")
    out = e.select(*[cents.alias(f.name) if f.name == "amount" else F.col(f.name) if f.name in e.columns
                     else F.lit(None).cast("string").alias(f.name) for f in EXPENSE_SCHEMA.fields])
    rows, _ = quarantine.read_expenses_checked(b.spark, b.spooled(out, "csv"))
    s = sinks.spend_rows(rows)
    return s.groupBy("date", "platform").agg(dbl(F.sum("amount_usd")).alias("amount_usd"))
