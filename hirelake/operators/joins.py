"""Joins that Spark lacks a plan for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bins of level n are 8^n seconds long.
_STEP = 3


def _seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def _bin(seconds: str, level: str) -> str:
    return f"shiftright({seconds}, {_STEP} * {level})"


def _binned(windows: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """The windows with their level, once for each bin that they touch."""
    length = _seconds(end_col) - _seconds(start_col) + 1
    level = F.ceil(F.log(2.0, length.cast("double")) / _STEP).cast("int")
    rows = windows.where(F.col(start_col) <= F.col(end_col)).withColumns({"_level": level, "_from": _seconds(start_col), "_to": _seconds(end_col)})
    return rows.withColumn("_bin", F.expr(f"explode(sequence({_bin('_from', '_level')}, {_bin('_to', '_level')}))")).drop("_from", "_to")


def interval_join(points: DataFrame, windows: DataFrame, point_col: str, start_col: str, end_col: str, closed: str = "both") -> DataFrame:
    """Pairs of a point and each window that holds it, ends included unless ``closed`` is "left".

    Each window goes into the bins of one level, the first whose bins are as long as it, so it is in two bins at most,
    whatever its length; a point goes into one bin of each level that has windows (twelve levels reach a thousand years).
    They are joined on level and bin with a residual test, never by a nested loop, and a point meets only windows that
    are about as long as its bin. The levels in use are read first, from the windows alone. Null ends match nothing.
    """
    spread = _binned(windows, start_col, end_col)
    levels = sorted(r[0] for r in spread.select("_level").distinct().collect())
    placed = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels))) if len(levels) > 1 else F.lit(levels[0] if levels else 0)).withColumn("_at", _seconds(point_col))
    inside = (F.col(point_col) >= F.col(start_col)) & ((F.col(point_col) <= F.col(end_col)) if closed == "both" else (F.col(point_col) < F.col(end_col)))
    return placed.withColumn("_bin", F.expr(_bin("_at", "_level"))).drop("_at").join(spread, ["_level", "_bin"]).where(inside).drop("_level", "_bin")


def merge_writer(target: DataFrame, batch: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """Insert or update by key, touching only the given columns; columns that the batch lacks are null in new rows."""
    new = batch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in update_cols], F.lit(True).alias("_in"))
    both = target.join(new, keys, "full_outer")
    return both.select(*[F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update_cols else F.col(c) for c in target.columns])


def patch_nonnull(target: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Updates existing rows with the patch's non-null fields."""
    fields = [c for c in patch.columns if c not in keys]
    new = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = target.join(new, keys, "left")
    return both.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in target.columns])
