"""Metering of signals, tenants and label cardinality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_summary(usage: DataFrame) -> DataFrame:
    return usage.groupBy("signal").agg(F.sum("events_count").alias("events"), F.sum("bytes_count").alias("bytes"))


def usage_by_tenant(usage: DataFrame, signals: list[str]) -> DataFrame:
    """(tenant_id, <one column a signal>, events), the largest first."""
    wide = usage.groupBy("tenant_id").pivot("signal", signals).agg(F.sum("events_count")).na.fill(0)
    total = reduce(lambda a, b: a + b, (F.col(s) for s in signals))
    return wide.withColumn("events", total).orderBy(F.desc("events"), "tenant_id")


def usage_breakdown(usage: DataFrame, unit: str = "day") -> DataFrame:
    at = F.unix_seconds(F.date_trunc(unit, "bucket")).alias("bucket")
    return usage.groupBy(at, "signal").agg(F.sum("events_count").alias("events"), F.sum("bytes_count").alias("bytes"))


def signal_totals(signals: dict[str, DataFrame], as_of: Column, window_s: int) -> DataFrame:
    """(signal, total, recent, per_second, today) of each table, counted in one pass a table."""
    now = F.unix_seconds(as_of)
    one = lambda name, df: df.agg(
        F.count("*").alias("total"), F.count_if(F.unix_seconds("ts") > now - window_s).alias("recent"), F.count_if(F.to_date("ts") == F.to_date(as_of)).alias("today")
    ).select(F.lit(name).alias("signal"), "total", "recent", (F.col("recent") / F.greatest(F.lit(1.0), F.lit(float(window_s)))).alias("per_second"), "today")
    return reduce(DataFrame.unionByName, [one(n, df) for n, df in signals.items()])


def stats_gauges(totals: DataFrame, at_ns: int) -> DataFrame:
    """Totals as gauge rows."""
    rows = F.array(*(F.struct(F.lit(f"signals.{c}").alias("metric_name"), F.col(c).cast("double").alias("value")) for c in ("total", "per_second", "today")))
    return totals.select(F.create_map(F.lit("signal"), F.col("signal")).alias("attributes"), F.lit(at_ns).cast("bigint").alias("ts_ns"), F.inline(rows))


def count_across(tables: list[DataFrame], condition: Column | None = None) -> DataFrame:
    """(total): rows of several tables; each is counted before the sums meet."""
    counted = [(df.where(condition) if condition is not None else df).agg(F.count("*").alias("n")) for df in tables]
    return reduce(DataFrame.unionByName, counted).agg(F.sum("n").alias("total"))


def series_count(samples: DataFrame, exact: bool = False) -> DataFrame:
    return samples.agg((F.countDistinct("series_key") if exact else F.approx_count_distinct("series_key")).alias("series"))


def metric_cardinality(tables: list[DataFrame], exact: bool = False) -> DataFrame:
    """(metric_name, series, labels): series of each metric over several tables, and the most labels of one."""
    rows = reduce(DataFrame.unionByName, [t.select("metric_name", "series_key", F.size(F.map_keys("attributes")).alias("n")) for t in tables])
    count = F.countDistinct("series_key") if exact else F.approx_count_distinct("series_key")
    return rows.groupBy("metric_name").agg(count.alias("series"), F.max("n").alias("labels"))


def label_cardinality(samples: DataFrame, metric: str) -> DataFrame:
    """(label, distinct_values) of one metric, with the service as a label."""
    rows = samples.where(F.col("metric_name") == metric)
    pairs = rows.select(F.explode("attributes").alias("label", "value")).unionByName(rows.select(F.lit("service_name").alias("label"), F.col("service_name").alias("value")))
    return pairs.groupBy("label").agg(F.countDistinct("value").alias("distinct_values"))


def unused_metrics(tables: list[DataFrame], queried: DataFrame) -> DataFrame:
    """(tenant_id, metric_name) that no query of the tenant has read."""
    names = reduce(DataFrame.unionByName, [t.select("tenant_id", "metric_name").distinct() for t in tables]).distinct()
    used = queried.select("tenant_id", F.col("signal_name").alias("metric_name"))
    return names.join(used, ["tenant_id", "metric_name"], "left_anti")


def tracked_signals(usage: DataFrame, as_of: Column, days: int = 30, limit: int = 1000) -> DataFrame:
    """The latest row of each signal, newest first, with whether it was queried in the last days."""
    keys = ["tenant_id", "signal_name", "signal_type", "source"]
    latest = usage.groupBy(*keys).agg(F.max_by(F.struct("last_queried_at", "query_count"), "last_queried_at").alias("r")).select(*keys, "r.*")
    recent = F.col("last_queried_at") >= as_of - F.make_interval(days=F.lit(days))
    return latest.withColumn("recent", recent).orderBy(F.desc("last_queried_at"), "signal_name").limit(limit)


def merge_usage(usage: DataFrame) -> DataFrame:
    """Hourly partial rows summed at read."""
    return usage.groupBy("tenant_id", "signal", "bucket").agg(F.sum("events_count").alias("events_count"), F.sum("bytes_count").alias("bytes_count"))
