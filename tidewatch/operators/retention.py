"""Retention: which rows stay, and the rewrite of the partitions that lose some."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.core import attr


def effective_days(default: int, rules: list[int]) -> int:
    """How long a table must keep anything: the longest of the default and the rules."""
    return max([default, *rules])


def capped_days(asked: int, default: int) -> int:
    """0 inherits the default; nothing is kept for less than a day."""
    return max(asked or default, 1)


def glob_to_regex(pattern: str) -> str:
    return "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def _named(column: Column, rule: dict, key: str) -> Column:
    pattern = rule.get(key, "")
    if not pattern:
        return F.lit(True)
    return column.rlike(pattern if rule.get("regex") else glob_to_regex(pattern))


def _expired(ts: Column, days: int, as_of: Column) -> Column:
    return ts < as_of - F.make_interval(days=F.lit(days))


def expired_metrics(rules: list[dict], as_of: Column, ts: str = "ts") -> Column:
    """Whether any rule (metric glob or regex, labels, days) has let a sample expire."""
    tests = []
    for rule in rules:
        labels = [attr("attributes", k) == v for k, v in rule.get("labels", {}).items()]
        tests.append(reduce(lambda a, b: a & b, labels, _named(F.col("metric_name"), rule, "metric")) & _expired(F.col(ts), rule["days"], as_of))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def expired_spans(rules: list[dict], as_of: Column, ts: str = "ts") -> Column:
    """The same for spans, by service and attributes (``environment`` is one of them)."""
    tests = []
    for rule in rules:
        labels = [attr("attributes", k) == v for k, v in rule.get("attributes", {}).items()]
        tests.append(reduce(lambda a, b: a & b, labels, _named(F.col("service_name"), rule, "service")) & _expired(F.col(ts), rule["days"], as_of))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def keep(df: DataFrame, expired: Column) -> DataFrame:
    return df.where(~F.coalesce(expired, F.lit(False)))


def keep_by_tenant(df: DataFrame, overrides: DataFrame, signal: str, default_days: int, as_of: Column, ts: str = "ts") -> DataFrame:
    """Tenants may keep a signal for less than the default, never for more. ``overrides`` has tenant_id, signal, days."""
    own = overrides.where(F.col("signal") == signal).groupBy("tenant_id").agg(F.min("days").alias("_days"))
    days = F.least(F.coalesce("_days", F.lit(default_days)), F.lit(default_days))
    joined = df.join(own, "tenant_id", "left")
    return joined.where(F.datediff(F.to_date(as_of), F.to_date(ts)) <= F.greatest(days, F.lit(1))).drop("_days")


def dry_run(df: DataFrame, expired: Column, by: list[str]) -> DataFrame:
    """(by, expired, kept): what a rewrite would drop."""
    gone = F.coalesce(expired, F.lit(False))
    return df.groupBy(*by).agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("kept"))


def rewrite(spark, path: str, expired: Column, partition: str = "date") -> list:
    """Rewrite the date partitions that hold expired rows, and no others; gives their dates.

    The kept rows are written beside the table first, in a folder of this run, since a
    partition cannot be read and overwritten in one job. A run that died leaves its folder
    and expired rows, and is simply repeated; the folder goes when a run ends well.
    """
    table = spark.read.parquet(path)
    dates = [r[0] for r in table.where(expired).select(partition).distinct().collect()]  # days of one table
    if dates:
        staged = f"{path.rstrip('/')}_staged_{uuid.uuid4().hex}"
        affected = table.where(F.col(partition).isin(dates))
        keep(affected, expired).write.mode("overwrite").partitionBy(partition).parquet(staged)
        emptied = set(dates) - {r[0] for r in spark.read.schema(table.schema).parquet(staged).select(partition).distinct().collect()}
        spark.read.schema(table.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        for gone in (*(f"{path}/{partition}={date}" for date in emptied), staged):  # nothing is left to overwrite those dates with
            folder = spark._jvm.org.apache.hadoop.fs.Path(gone)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(dates)
