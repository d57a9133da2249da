"""Joins of points with intervals by equality on time bins.

An interval has bins about as wide as itself: lengths are sorted into levels, eight times as
long each, and an interval has the one or two bins of its level that it touches. A point has one
bin of each level in use. So both sides meet by hash, the check of the bounds that is left
throws away a bounded part, and neither side has to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Microseconds of the bins of level 0, and how much wider each level's are.
UNIT, FACTOR = 1_000_000, 8


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _width(level: Column) -> Column:
    return (F.lit(UNIT) * F.pow(F.lit(FACTOR), level)).cast("bigint")


def binned(intervals: DataFrame, start: str = "starts", end: str = "ends") -> DataFrame:
    """``intervals`` once for each bin: with ``level_``, ``bin_``, ``low_`` and ``high_`` (microseconds, both included).

    Intervals without a bound, or that end before they start, hold no point and go.
    """
    rows = intervals.withColumns({"low_": _micros(start), "high_": _micros(end)}).where("low_ <= high_")
    length = F.greatest(F.col("high_") - F.col("low_"), F.lit(1))
    level = F.greatest(F.ceil(F.log(float(FACTOR), length / UNIT)), F.lit(0)).cast("int")
    wide = rows.withColumn("level_", level).withColumn("width_", _width(F.col("level_")))
    bins = F.sequence(F.floor(F.col("low_") / F.col("width_")), F.floor(F.col("high_") / F.col("width_")))
    return wide.withColumn("bin_", F.explode(bins)).drop("width_")


def levels_in_use(intervals: DataFrame, start: str = "starts", end: str = "ends") -> list[int]:
    """The levels of ``intervals``: a century has level 11."""
    return sorted(r[0] for r in binned(intervals, start, end).select("level_").distinct().collect())


def interval_join(points: DataFrame, intervals: DataFrame, ts: str = "ts", start: str = "starts", end: str = "ends", keys: dict[str, str] | None = None) -> DataFrame:
    """Every point with every interval that holds it, both ends included; ``keys`` (of points to of intervals) are equal too.

    The intervals' columns come after those of the points. Points without a time match nothing.
    """
    used = levels_in_use(intervals, start, end)
    rows = points.withColumn("at_", _micros(ts)).withColumn("level_", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    rows = rows.withColumn("bin_", F.floor(F.col("at_") / _width(F.col("level_"))))
    right = binned(intervals, start, end).withColumnsRenamed({"level_": "level_r", "bin_": "bin_r"})
    same = (rows["level_"] == right["level_r"]) & (rows["bin_"] == right["bin_r"]) & (F.col("at_") >= F.col("low_")) & (F.col("at_") <= F.col("high_"))
    for left, name in (keys or {}).items():
        same &= rows[left] == right[name]
    return rows.join(right, same).drop("level_", "bin_", "at_", "level_r", "bin_r", "low_", "high_")


def outside(points: DataFrame, intervals: DataFrame, ts: str = "ts", start: str = "starts", end: str = "ends", keys: dict[str, str] | None = None) -> DataFrame:
    """The points that no interval holds, one anti-join for each level in use."""
    right = binned(intervals, start, end)
    for level in levels_in_use(intervals, start, end):
        bins = right.where(F.col("level_") == level).select(F.col("bin_").alias("bin_r"), "low_", "high_", *(F.col(name).alias(f"{name}_r") for name in (keys or {}).values()))
        rows = points.withColumn("at_", _micros(ts)).withColumn("bin_", F.floor(F.col("at_") / (UNIT * FACTOR**level)))
        same = (F.col("bin_") == F.col("bin_r")) & (F.col("at_") >= F.col("low_")) & (F.col("at_") <= F.col("high_"))
        for left, name in (keys or {}).items():
            same &= F.col(left) == F.col(f"{name}_r")
        points = rows.join(bins, same, "left_anti").drop("at_", "bin_")
    return points
