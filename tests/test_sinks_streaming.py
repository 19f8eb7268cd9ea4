"""Idempotent append, record export and the streaming ingest."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from ledgerlens.sources import sinks
from ledgerlens.sources.id_table import IdTable
from ledgerlens.streaming.ingest import start_spend_ingest

HEADER = "id,date,postedDate,type,amount,merchantName,authorizationStatus,currency,cardholderEmail"


def _csv(path, rows):
    with open(path, "w") as f:
        f.write("\n".join([HEADER] + rows))


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("1", "2026-01-01", -10.0, "FACEBK X"), ("1", "2026-01-01", -10.0, "FACEBK X"),
                                ("2", "2026-01-02", -5.0, "Google Ads"), ("3", "2026-01-02", -1.0, "SHOP")],
                               "id string, date string, amount double, merchantName string")
    rows = sinks.spend_rows(df)
    target = str(tmp_path / "spend")
    assert sinks.append_new_rows(rows, target) == (2, 1)
    assert sinks.append_new_rows(rows, target) == (0, 3)
    assert IdTable(spark, target).read().count() == 2


def test_export_records(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2026, 1, 1), 1.5)], "month date, v double")
    assert sinks.export_records(df).first().record == '{"month":"2026-01-01","v":1.5}'


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _csv(src / "a.csv", ["1,2026-02-15,,spend,-99.00,FACEBK ADS,approved,usd,x", "8,2026-01-10,,spend,-5,STRIPE,approved,usd,x"])
    target = str(tmp_path / "spend")
    ckpt = str(tmp_path / "ckpt")
    q = start_spend_ingest(spark, str(src), target, ckpt)
    q.awaitTermination(120)
    _csv(src / "b.csv", ["1,2026-02-15,,spend,-99.00,FACEBK ADS,approved,usd,x", "2,2026-02-16,,spend,-7,DL *GOOGLE ADS1,approved,usd,x"])
    q = start_spend_ingest(spark, str(src), target, ckpt)
    q.awaitTermination(120)
    got = sorted((r.id, r.platform) for r in IdTable(spark, target).read().collect())
    assert got == [("1", "meta"), ("2", "google")]
