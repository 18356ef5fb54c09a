"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import delete, shared_path

_made: list[str] = []
#: Rows and bytes that Spark hands to Python at a time while a table is written. It holds a batch twice over outside its
#: heap, and Python once more, in every task; the texts of a batch are worked on a megabyte at a time anyway.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, queries that run hand Python batches of ``BATCHES`` at most; a session's smaller limit of rows stays."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for key, value in BATCHES.items():
            if key != rows or not 0 < int(before[rows]) < int(value):
                spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes on leaving, after a failure too, what ``written`` made inside, but for the paths that the caller puts into the
    list it gets."""
    before, keep = _made[:], []
    try:
        yield keep
    finally:
        for path in _made[len(before) :]:
            if path not in keep:
                delete(spark, path)
        _made[len(before) :] = keep


def newest() -> str:
    """The path of the table that ``written`` made last."""
    return _made[-1]
