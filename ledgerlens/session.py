"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on: UTC wall clock, AQE for skew and
# partition coalescing, and no UI server.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No capture of a call site for each column expression: plans here have thousands.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpoint files of multi-pass operators are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """Local/test session builder.  On a cluster the caller's session is used as is."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_python_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is.  Where it is
    absent, a local session (tests) gets a fresh scratch folder, and any other
    one an error: its executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = local_scratch(spark.sparkContext.master)
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def written_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back:
    cuts the lineage like a checkpoint, and the size estimates of loops with it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_scratch(master: str) -> str:
    """A scratch folder for a session whose executors are this process."""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="ledgerlens-ckpt-")


def ensure_python_package(spark: SparkSession) -> None:
    """Make ``ledgerlens`` importable in the Python workers (Arrow/pandas steps
    reference its helpers): zip the package once and ``addPyFile`` it, the
    same mechanism as ``--py-files``.  Done once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerlens_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="ledgerlens-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "ledgerlens"), "zip", root_dir=os.path.dirname(pkg_dir),
                                  base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    sc._ledgerlens_shipped = True
