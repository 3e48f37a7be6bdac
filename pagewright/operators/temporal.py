"""Joins over time and ranges (extensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, time: str, value: str, most: Column | None = None) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` of the same ``by`` at or before its ``time``; null if there is none (or it is older than ``most`` seconds).

    Both sides are put into one order and the last value is carried on, so a key's rows
    are sorted once and never paired.
    """
    cols = left.columns
    rows = left.select(F.struct(*cols).alias("_l"), F.col(by).alias("_by"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[time].dataType).alias("_vt"))
    other = right.where(F.col(value).isNotNull()).select(F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), F.col(by).alias("_by"), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(time).alias("_vt"))
    w = Window.partitionBy("_by").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_v", "_vt")), ignorenulls=True).over(w)
    got = rows.unionByName(other).withColumn("_seen", seen).where("_side = 1")
    fresh = F.lit(True) if most is None else F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_seen._vt").cast("timestamp")) <= most * 1_000_000
    return got.select("_l.*", F.when(fresh, F.col("_seen._v")).alias(value))


def in_ranges(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Points with every range (both ends in) that holds them: an equi join on the steps of ``width`` that a range touches, so no point meets all ranges. Choose the width near the usual length of a range."""
    cells = ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    j = points.withColumn("_cell", F.floor(F.col(point) / width)).join(cells, "_cell")
    return j.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_cell")
