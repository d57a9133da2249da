"""Mergeable rollups of metric samples, and the choice of what a query reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest spans, in seconds, that read raw samples and minutes.
RAW_SPAN, MINUTE_SPAN = 6 * 3600, 2 * 86400
ABOUT = ("metric_description", "metric_unit")


def rollup(samples: DataFrame, seconds: int, order: str | None = None) -> DataFrame:
    """(series_key, bucket, sum, cnt, min, max, last_value, last_ms): partial rows that merge without loss.

    Samples with ``metric_description`` or ``metric_unit`` keep the last one of each. Of several
    samples of the last millisecond the value is the largest; with ``order``, a numeric column,
    it is that of the first in this order, kept as ``last_order``.
    """
    latest = F.struct("ts_ms", *([(-F.col(order)).alias("order")] if order else []), "value")
    width = seconds * 1000
    start = (F.floor(F.col("ts_ms") / width) * seconds).cast("bigint")
    return samples.groupBy("series_key", start.alias("bucket")).agg(
        F.sum("value").alias("sum"), F.count("*").alias("cnt"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", latest).alias("last_value"), F.max("ts_ms").alias("last_ms"),
        *([(-F.max(latest)["order"]).alias("last_order")] if order else []),
        *(F.max_by(c, F.struct("ts_ms", "value", c)).alias(c) for c in ABOUT if c in samples.columns),
    )


def merge(partials: DataFrame, seconds: int | None = None) -> DataFrame:
    """Merge partial rows of the same bucket, or into coarser buckets. Late rows only add partials."""
    ordered = "last_order" in partials.columns
    latest = F.struct("last_ms", *([(-F.col("last_order")).alias("order")] if ordered else []), "last_value")
    start = F.col("bucket") if seconds is None else (F.floor(F.col("bucket") / seconds) * seconds).cast("bigint")
    return partials.groupBy("series_key", start.alias("bucket")).agg(
        F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt"), F.min("min").alias("min"), F.max("max").alias("max"), F.max_by("last_value", latest).alias("last_value"), F.max("last_ms").alias("last_ms"),
        *([(-F.max(latest)["order"]).alias("last_order")] if ordered else []),
        *(F.max_by(c, F.struct("last_ms", "last_value", c)).alias(c) for c in ABOUT if c in partials.columns),
    )


def finished(rolled: DataFrame, counter: bool = False) -> DataFrame:
    """(series_key, bucket, avg, min, max, last, cnt) as a reader sees them; counters have no average."""
    avg = [] if counter else [(F.col("sum") / F.col("cnt")).alias("avg")]
    return rolled.select("series_key", "bucket", *avg, "min", "max", F.col("last_value").alias("last"), "cnt", *(c for c in ABOUT if c in rolled.columns))


def choose_source(start_s: int, end_s: int, bucket_s: int, needs_samples: bool = False) -> str:
    """``raw``, ``1m`` or ``1h``: the coarsest rollup that can answer a query.

    Short spans, buckets or edges that a rollup does not align with, and predicates on
    single samples read raw rows.
    """
    span = end_s - start_s
    if needs_samples or span <= RAW_SPAN:
        return "raw"
    fits = lambda unit: bucket_s % unit == 0
    if span > MINUTE_SPAN and fits(3600):
        return "1h"
    return "1m" if fits(60) else "raw"


def backfill(samples: DataFrame, seconds: int, now_s: int, order: str | None = None) -> DataFrame:
    """Rollup of the buckets that are closed at ``now_s``; the open one is left to the stream."""
    cutover = now_s // seconds * seconds
    return rollup(samples.where(F.col("ts_ms") < cutover * 1000), seconds, order)


def backfill_if_empty(samples: DataFrame, target: DataFrame | None, seconds: int, now_s: int) -> DataFrame | None:
    """The backfill of a rollup that has no row yet, or None: a stream that has begun to fill one owns all of it."""
    return backfill(samples, seconds, now_s) if target is None or target.isEmpty() else None
