"""Load and export queries: they return what a load would write, or read files
that they wrote to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.campaigns import load_ad_spend
from ..sources import sinks
from ..sources.binding import Bound
from ..sources.files import EXPENSE_SCHEMA, read_expense_csv
from .oracle_views import with_views
from .registry import query

# A previously loaded spend table (exports up to 1997) and a new export batch
# that repeats a year (1999 twice), so both 'already loaded' and 'duplicate in
# batch' rows occur.


def _target(b: Bound):
    return sinks.spend_rows(b.expense_export).where(F.col("date") < F.lit("1998-01-01").cast("date"))


def _batch(b: Bound):
    s = sinks.spend_rows(b.expense_export)
    return s.unionByName(s.where(F.year("date") == 1999))


_SPEND_SQL = """
    SELECT id, "date", CAST(abs(amount) AS DECIMAL(10,4)) AS amount_usd, platform FROM (
      SELECT *, CASE WHEN merchantName LIKE 'FACEBK%' THEN 'meta'
                     WHEN lower(merchantName) LIKE '%google ads%' THEN 'google' END AS platform FROM expense_export)
    WHERE platform IS NOT NULL"""


@query("append_new_rows", with_views(f"""
    WITH s AS ({_SPEND_SQL}),
         b AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE year("date") = 1999),
         d AS (SELECT DISTINCT id, "date", amount_usd, platform FROM b)
    SELECT id, "date", CAST(amount_usd AS DOUBLE) AS amount_usd, platform FROM d
    WHERE id NOT IN (SELECT id FROM s WHERE "date" < DATE '1998-01-01')""", "expense_export"))
def _append(b: Bound):
    n = sinks.new_rows(_batch(b), _target(b))
    return n.withColumn("amount_usd", F.col("amount_usd").cast("double"))


@query("append_new_rows_counts", with_views(f"""
    WITH s AS ({_SPEND_SQL}),
         b AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE year("date") = 1999),
         n AS (SELECT count(DISTINCT id) AS c FROM b WHERE id NOT IN (SELECT id FROM s WHERE "date" < DATE '1998-01-01'))
    SELECT n.c AS rows_inserted, (SELECT count(*) FROM b) - n.c AS rows_skipped FROM n""", "expense_export"))
def _append_counts(b: Bound):
    batch = _batch(b)
    return sinks.load_counts(batch, sinks.new_rows(batch, _target(b)))


@query("export_records", with_views("SELECT * FROM summary", "summary"))
def _export(b: Bound):
    """The exported records, read back: the text of a record keeps every value."""
    from .ramp_plans import _summary
    records = sinks.export_records(_summary(b))
    return records.select(F.from_json("record", "metric string, value double").alias("_r")).select("_r.*")


@query("read_expense_csv", with_views("""
    SELECT "date", platform, CAST(sum(amount_usd) AS DOUBLE) AS daily_spend_usd FROM (
      SELECT "date", abs(round(amount, 2)) AS amount_usd,
             CASE WHEN merchantName LIKE 'FACEBK%' THEN 'meta'
                  WHEN lower(merchantName) LIKE '%google ads%' THEN 'google' END AS platform FROM expense_export)
    WHERE platform IS NOT NULL GROUP BY 1, 2""", "expense_export"))
def _read_expenses(b: Bound):
    """The expense export written as CSV files, read back and loaded."""
    e = b.expense_export
    cents = F.round("amount", 2).cast("decimal(18,2)")
    out = e.select(*[cents.alias(f.name) if f.name == "amount" else F.col(f.name) if f.name in e.columns
                     else F.lit(None).cast("string").alias(f.name) for f in EXPENSE_SCHEMA.fields])
    spend = load_ad_spend(read_expense_csv(b.spark, b.spooled(out, "csv")))
    return spend.withColumn("daily_spend_usd", F.col("daily_spend_usd").cast("double"))
