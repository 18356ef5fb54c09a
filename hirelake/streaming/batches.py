"""What micro-batches write: a folder a batch under path/out. A repeated batch overwrites its own folder, so results are exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import delete


def start_latest(stream: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Starts an aggregation whose whole result each micro-batch replaces under path/out/batch=n; the greatest n is valid."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        delete(batch.sparkSession, f"{path}/out/batch={n - 2}")

    return stream.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def results(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """What ended batches have written; of a replaced result only the newest."""
    rows = spark.read.parquet(f"{path}/out")
    if latest:
        newest = rows.agg({"batch": "max"}).first()[0]
        rows = rows if newest is None else rows.where(rows.batch == newest)
    return rows.drop("batch")
