"""File sources with explicit schemas (no inference): expense CSV exports and
invoice JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.invoices import INVOICE_SCHEMA, validate_invoices

EXPENSE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("postedDate", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("merchantName", T.StringType()),
    T.StructField("authorizationStatus", T.StringType()), T.StructField("currency", T.StringType()),
    T.StructField("cardholderEmail", T.StringType()),
])


def read_expense_csv(spark: SparkSession, path: str) -> DataFrame:
    """Card-expense CSV export(s): a file, folder or glob."""
    return spark.read.schema(EXPENSE_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_invoices(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Invoice JSON documents (any number of files, one invoice each when
    multiline) -> typed rows; rows with a negative or missing number are dropped."""
    df = spark.read.schema(INVOICE_SCHEMA).option("multiLine", multiline).json(path)
    return validate_invoices(df)
