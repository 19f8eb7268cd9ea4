"""Expense files with a table of the records that could not be loaded.

Every record is read as text fields and checked field by field.  A record that
passes goes to the rows, any other to the rejects, with its file, the place of the
split it is in, the record as it stands and the reasons; nothing is read as null and lost
in a sum.  Loaded and rejected records add up to those read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import EXPENSE_SCHEMA

RECORD = "_record"


def _checks(fields: T.StructType, required: tuple[str, ...]) -> list[Column]:
    """One reason (or null) for each way in which a record can fail."""
    out = [F.when(F.col(RECORD).isNotNull(), F.lit("columns"))]
    for f in fields:
        missing = F.col(f.name).isNull() | (F.trim(F.col(f.name)) == "")
        if f.name in required:
            out.append(F.when(F.col(RECORD).isNull() & missing, F.lit(f"{f.name} missing")))
        if not isinstance(f.dataType, T.StringType):
            out.append(F.when(F.col(RECORD).isNull() & ~missing & _typed(f).isNull(), F.lit(f"{f.name} not a {f.dataType.typeName()}")))
    return out


def _typed(f: T.StructField) -> Column:
    if isinstance(f.dataType, T.DateType):
        # A date with a time or a stray sign is no date.
        return F.when(F.trim(F.col(f.name)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(f.name).try_cast("date"))
    if isinstance(f.dataType, T.DecimalType):
        exact = F.col(f.name).try_cast(T.DecimalType(38, 18))
        typed = exact.try_cast(f.dataType)
        return F.when(exact == typed, typed)      # digits that the type has no room for are an error
    return F.col(f.name).try_cast(f.dataType)


def read_expenses_checked(spark: SparkSession, path: str, schema: T.StructType = EXPENSE_SCHEMA,
                          required: tuple[str, ...] = ("id", "date", "amount", "merchantName"),
                          header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of ``schema``, rejects: file, split_start, record, reasons) of CSV files with
    a header: a file, folder or glob."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(RECORD, T.StringType())])
    raw = spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    checked = raw.withColumn("_reasons", F.array_compact(F.array(*_checks(schema, required))))
    good = F.size("_reasons") == 0
    rows = checked.where(good).select(*[_typed(f).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f.name)
                                        for f in schema])
    record = F.coalesce(F.col(RECORD), F.to_csv(F.struct(*[F.col(f.name) for f in schema])))
    rejects = checked.where(~good).select(F.col("_file").alias("file"), F.col("_at").alias("split_start"), record.alias("record"),
                                          F.col("_reasons").alias("reasons"))
    return rows, rejects


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Rejected records by reason (a record with two reasons counts for both)."""
    return rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_records"))
