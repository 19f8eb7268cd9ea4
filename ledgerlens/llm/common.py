"""Helpers shared by the training-data operators: table reads, word splitting,
tables in the shared checkpoint folder, and the Arrow map wrapper."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ensure_python_package

#: Separators of the word contracts: [\x20\x09-\x0D].  ``bytes.split()`` without
#: arguments splits UTF-8 text at exactly these six bytes.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_python_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text (null text: none), split at :data:`SPACE`."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Spark's setting that removes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read
    back: cuts the lineage, and a lost executor costs no recomputation.  The shuffle
    files of the write are removed with it, so those of many steps do not add up."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch.  ``make()`` runs
    once per task and returns a function from a batch to output columns."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        out = _arrow_schema(fields)
        for batch in batches:
            cols = step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(fields)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a string column, one value at a time; null is empty."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def uncollected(step: Callable) -> Callable:
    """``step`` without passes of Python's cycle collector: they would walk large caches
    that have no cycles again and again."""
    @wraps(step)
    def run(*args):
        was = gc.isenabled()
        gc.disable()
        try:
            return step(*args)
        finally:
            if was:
                gc.enable()
    return run


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def nested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as row (all columns in a struct, so that no name of theirs meets one used
    here), id, text and th (hash of the text)."""
    text = quoted(text_col)
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), quoted(id_col).alias("id"), text.alias("text"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))


def spread(rows: DataFrame, docs: DataFrame, text_col: str | None = None, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` from rows of :func:`nested`, with another text if given."""
    return rows.select(*[(text if text is not None and c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def same_text(rows: DataFrame, of: DataFrame) -> Column:
    """Join condition of two tables with id and th; null ids are equal."""
    return rows["id"].eqNullSafe(of["id"]) & (rows["th"] == of["th"])


def with_decisions(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``rows`` of :func:`nested` with the columns of a written table ``decided`` (one row
    for an id and th), null where it has none.  Only documents that have a row there
    are shuffled, if their ids are few; arrays are never broadcast by hint."""
    ids = decided.select("id", "th")
    payload = [c for c in decided.columns if c not in ("id", "th")]
    few = ids.count() <= SMALL_ROWS
    touched = rows.join(F.broadcast(ids), same_text(rows, ids), "left_semi") if few else rows
    other = decided.select(F.col("id").alias("_id"), F.col("th").alias("_th"), *payload)
    met = touched.join(other, touched["id"].eqNullSafe(other["_id"]) & (touched["th"] == other["_th"]),
                       "inner" if few else "left").drop("_id", "_th")
    if not few:
        return met
    rest = rows.join(F.broadcast(ids), same_text(rows, ids), "left_anti")
    return met.unionByName(rest, allowMissingColumns=True)


#: Rows up to which a written table of ids or hashes may be broadcast.  Such a row has
#: a few numbers, so the table has some 10 MB at most.
SMALL_ROWS = 200_000


def if_small(table: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``table`` (written; rows of fixed size) marked for a broadcast join if its counted
    rows are within the limit; beyond it the join is left to shuffle."""
    return F.broadcast(table) if table.count() <= limit else table
