"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.binding import Bound


@dataclass
class Entry:
    key: str
    build: Callable[[Bound], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(bound) -> DataFrame`` under ``key`` with its oracle SQL."""
    def deco(fn: Callable[[Bound], DataFrame]):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # Importing the modules registers their queries.
    from . import ramp_plans  # noqa: F401
    for mod in ("user_plans", "cohort_plans", "campaign_plans", "pricing_plans",
                "invoice_plans", "series_plans", "io_plans", "incremental_plans", "window_plans"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{mod}":
                raise
    return REGISTRY


def runner(key: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = load_all()[key]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import ensure_python_package
        ensure_python_package(spark)
        return entry.build(Bound(spark, sf_dir))
    return run
