"""Materialised intermediates.

``materialize`` writes a frame as Parquet under the shared checkpoint folder
(``spark.checkpoint.dir``) and reads it back: lineage is cut, the result
survives executor loss, and later readers get column pruning and predicate
pushdown on it.  ``PlanContext`` memoises such tables for the duration of one
query build, so a fact used by several branches is computed and shuffled once.

The plan is the same at every size: a shared fact is always written, a small
derived side never is, and joins with it are left to Spark, which broadcasts
it only if its measured size allows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.session import ensure_checkpoint_dir


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside free their shuffle files when they end; else those
    stay on disk until the driver happens to collect garbage."""
    given = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, given)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


FOLDER = "version_folder"
VERSIONS_PER_FOLDER = 16


def folder_of(version: Column | str) -> Column:
    return F.floor((F.col(version) if isinstance(version, str) else version) / F.lit(VERSIONS_PER_FOLDER)).cast("int")


def write_by_version(df: DataFrame, path: str, by: str = "requirement_version") -> DataFrame:
    """Write ``df`` in folders of ``VERSIONS_PER_FOLDER`` neighbouring versions, and read it back with ``FOLDER``.

    A read of some versions opens their folders only; inside, the files are
    sorted by version, so their statistics skip the rest.  Folders of single
    versions would be as many small files as there have been publishes.  The
    schema is given on reading: an empty table has no folder to infer it from.
    """
    spark = df.sparkSession
    rows = df.withColumn(FOLDER, folder_of(by))
    rows.repartition(FOLDER).sortWithinPartitions(FOLDER, by).write.mode("overwrite").partitionBy(FOLDER).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class PlanContext:
    """Per-query memo of shared intermediates."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._published_at: str | None = None

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A shared fact: written once, read by every branch."""
        if name not in self._tables:
            df = build()
            with shuffles_freed(self.spark):
                self._tables[name] = materialize(self.spark, df, name)
        return self._tables[name]

    def published(self, name: str, build: Callable[[], DataFrame], by: str = "requirement_version") -> DataFrame:
        """A published table, written once (``write_by_version``); it keeps its folder column."""
        if name not in self._tables:
            self._tables[name] = write_by_version(build(), f"{self._root()}/{name}", by)
        return self._tables[name]

    def _root(self) -> str:
        if self._published_at is None:
            self._published_at = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/published/{uuid.uuid4().hex[:12]}"
        return self._published_at

    def derived(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame derived from shared facts: kept lazy."""
        if name not in self._tables:
            self._tables[name] = build()
        return self._tables[name]
