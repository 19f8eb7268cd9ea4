"""A table of rows with unique ids that is loaded without reading all of it.

Layout below the table's folder:

* ``data/<load>/``: Parquet files of one load, sorted by id;
* ``_manifest/v=<n>/``: the table's version ``n``: a row for each data file with its
  load, rows, least and greatest id, and a Bloom filter of its ids.

A load finds the ids it already has in three steps: files whose id range overlaps no
range of the batch are out; ids that the Bloom filter of an overlapping file
does not hold are new; only the files that may hold some id are read and compared.
A load of ids beyond those of the table reads the manifest and no data file.

Ids that come in no order overlap every file's range; the filters decide then, an id
against each load's files, so such a table should be compacted from time to time.

A load writes its files first, where no reader looks, and publishes them by
renaming the finished manifest of the next version into place.  Readers read the files of the
last manifest only, so a load that is killed leaves nothing behind that they see, and
of two loads at once the second to publish fails and can be run again.  A load may carry
a tag; a tag that is already in the table is not loaded twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written_table

#: Bits of the filter for each id, hashes of an id, and bits of one stored piece (those
#: of Spark's bitmaps).
BITS_PER_ID, HASHES, PIECE_BITS = 16, 4, 32_768
#: Ranges by which a batch is compared with the ranges of files.
BATCH_RANGES = 64


class IdTable:
    """``key`` is the id column, compared as a string."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # ------------------------------------------------------------- versions
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Number of the last published version; 0 for a table without loads."""
        fs, p = self._fs(f"{self.path}/_manifest")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """file, load, tag, rows, least, greatest, pieces (of its filter) of every data
        file, or None for a table without loads."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/_manifest/v={version}") if version else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version (the last by default), or None."""
        manifest = self.manifest(version)
        if manifest is None:
            return None
        # One folder for each load; a load's folder is published whole.
        loads = [r["load"] for r in manifest.select("load").distinct().orderBy("load").collect()]
        return self.spark.read.parquet(*[f"{self.path}/data/{load}" for load in loads]) if loads else None

    # ------------------------------------------------------------ membership
    def _bits(self, key: Column, pieces: Column) -> list[Column]:
        """Places of an id in a filter of ``pieces`` pieces."""
        return [F.pmod(F.xxhash64(key, F.lit(h)), pieces * PIECE_BITS) for h in range(HASHES)]

    def candidate_files(self, ids: DataFrame, manifest: DataFrame) -> DataFrame:
        """(key, file) of the ids that a file may hold: by range, then by filter."""
        # Ranges of the batch: neighbouring ids, so that gaps between them show.
        ranged = ids.repartitionByRange(BATCH_RANGES, self.key).groupBy(F.spark_partition_id().alias("part")).agg(
            F.min(self.key).alias("lo"), F.max(self.key).alias("hi"))
        spans = written_table(ranged.select("lo", "hi"), "batch-ranges")     # at most BATCH_RANGES rows
        files = manifest.select("file", "n_pieces", "least", "greatest")
        overlapping = files.join(F.broadcast(spans), (F.col("least") <= F.col("hi")) & (F.col("greatest") >= F.col("lo")))
        wanted = ids.join(F.broadcast(spans), F.col(self.key).between(F.col("lo"), F.col("hi")))
        pairs = wanted.join(overlapping.distinct(), ["lo", "hi"]).where(
            F.col(self.key).between(F.col("least"), F.col("greatest"))).select(self.key, "file", "n_pieces")
        cells = pairs.select(self.key, "file", F.explode(F.array(*self._bits(F.col(self.key), F.col("n_pieces")))).alias("cell"))
        cells = cells.select(self.key, "file", F.expr(f"cell div {PIECE_BITS}").alias("piece"), (F.col("cell") % PIECE_BITS).alias("at"))
        stored = manifest.select("file", F.explode("pieces").alias("p")).select("file", "p.piece", "p.bits")
        byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = cells.join(stored, ["file", "piece"]).where(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
        return hit.groupBy(self.key, "file").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == HASHES).select(self.key, "file")

    def held(self, ids: DataFrame) -> tuple[DataFrame, list[str]]:
        """The distinct ids of ``ids`` that the table holds, and the data files that were
        read to find them."""
        ids = written_table(ids.select(F.col(self.key).cast("string").alias(self.key)).where(F.col(self.key).isNotNull())
                            .distinct(), "batch-ids")
        manifest = self.manifest()
        if manifest is None:
            return ids.limit(0), []
        maybe = written_table(self.candidate_files(ids, manifest), "candidates")
        files = [r["file"] for r in maybe.select("file").distinct().orderBy("file").collect()]
        if not files:
            return ids.limit(0), []
        found = self.spark.read.parquet(*files).select(F.col(self.key).cast("string").alias(self.key))
        return found.join(maybe.select(self.key).distinct(), self.key, "left_semi").distinct(), files

    # ----------------------------------------------------------------- loads
    def _described(self, load: str, tag: str | None) -> DataFrame:
        """Manifest rows of the files of a load."""
        rows = self.spark.read.parquet(f"{self.path}/data/{load}").select(
            F.col("_metadata.file_path").alias("file"), F.col(self.key).cast("string").alias("k"))
        sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("least"), F.max("k").alias("greatest"))
        sizes = sizes.withColumn("n_pieces", F.ceil(F.col("rows") * BITS_PER_ID / PIECE_BITS).cast("long"))
        cells = rows.join(F.broadcast(sizes.select("file", "n_pieces")), "file").select(
            "file", F.explode(F.array(*self._bits(F.col("k"), F.col("n_pieces")))).alias("cell"))
        pieces = cells.groupBy("file", F.expr(f"cell div {PIECE_BITS}").alias("piece")).agg(
            F.bitmap_construct_agg(F.col("cell") % PIECE_BITS).alias("bits"))
        filters = pieces.groupBy("file").agg(F.collect_list(F.struct("piece", "bits")).alias("pieces"))
        return sizes.join(filters, "file").select("file", F.lit(load).alias("load"), F.lit(tag).cast("string").alias("tag"),
                                                  "rows", "least", "greatest", "n_pieces", "pieces")

    def publish(self, rows: DataFrame, base: int, tag: str | None = None, files: int | None = None,
                before_publish: Callable[[], None] | None = None, replace: bool = False) -> int:
        """Writes ``rows`` as a load and makes them part of version ``base`` + 1, or all
        of it."""
        load = uuid.uuid4().hex
        if files:
            rows = rows.repartitionByRange(files, self.key)
        else:
            rows = rows.repartitionByRange(F.col(self.key))
        rows.sortWithinPartitions(self.key).write.parquet(f"{self.path}/data/{load}")
        added = self._described(load, tag)
        old = None if replace else self.manifest(base)
        staged = f"{self.path}/_staged/{load}"
        (added if old is None else old.unionByName(added)).write.parquet(staged)
        if before_publish is not None:
            before_publish()
        self._rename(staged, f"{self.path}/_manifest/v={base + 1}")
        return base + 1

    def _rename(self, staged: str, target: str) -> None:
        """Moves a folder to a place that has to be free, in one step."""
        sc = self.spark.sparkContext
        fs, to = self._fs(target)
        fs.mkdirs(to.getParent())
        hadoop = sc._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        options = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            context.rename(self._fs(staged)[1], to, options)
        except Py4JJavaError as e:
            if fs.exists(to):
                raise RuntimeError(f"{target} was published by another load") from e
            raise

    def compact(self, files: int | None = None) -> int:
        """Publishes a version with all rows in one load: fewer and larger files, with
        ranges that do not overlap."""
        base = self.version()
        return self.publish(self.read(base), base, None, files, replace=True) if base else 0

    def load(self, batch: DataFrame, tag: str | None = None, order: list[Column] | None = None, files: int | None = None,
             before_publish: Callable[[], None] | None = None) -> tuple[int, int]:
        """Adds the rows of a batch whose id is new: of rows with one id the first by
        ``order`` (the whole row by default).  Rows without an id are skipped.  Returns
        the numbers of rows inserted and skipped."""
        base = self.version()
        manifest = self.manifest(base)
        if tag is not None and manifest is not None and manifest.where(F.col("tag") == tag).limit(1).count():
            return 0, batch.count()
        columns = batch.columns
        rest = [F.col(f"`{c}`") for c in columns if c != self.key]
        rows = batch.withColumn(self.key, F.col(self.key).cast("string"))
        first = rows.groupBy(self.key).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("_row"),
                                           F.count(F.lit(1)).alias("_n"))
        first = written_table(first, "batch")
        held, _ = self.held(first.select(self.key))
        fresh = first.where(F.col(self.key).isNotNull()).join(held, self.key, "left_anti")
        counts = first.agg(F.sum("_n").alias("n")).first()
        total = int(counts["n"] or 0)
        kept = [F.col(f"`{c}`").cast(batch.schema[c].dataType).alias(c) if c == self.key else F.col(f"`{c}`") for c in columns]
        fresh = written_table(fresh.select(self.key, "_row.*").select(*kept), "fresh")
        inserted = fresh.count()
        if inserted:
            self.publish(fresh, base, tag, files, before_publish)
        return inserted, total - inserted
