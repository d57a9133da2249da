"""Monitors, service-level objectives, anomalies and detections, many rules at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from tidewatch.functions.core import bucket, is_error, milliseconds, percentile, percentiles
from tidewatch.operators import series
from tidewatch.operators.intervals import outside
from tidewatch.operators.states import applied, replay, state_after, step  # noqa: F401

# ---------------------------------------------------------------- state machine


def next_state(state: Column, value: Column, critical: Column, critical_recovery: Column, warning: Column, warning_recovery: Column, comparator: Column) -> Column:
    """The state of a threshold monitor after one value: ``states.step`` applied to the state before."""
    return applied(step(value, critical, critical_recovery, warning, warning_recovery, comparator), state)


def no_data_state(state: Column, action: Column) -> Column:
    """The state where a rule had no rows: resolved rules become ok, others no_data."""
    return F.when(action == "resolve", "ok").otherwise("no_data")


def evaluate(rules: DataFrame, results: DataFrame, previous: DataFrame) -> DataFrame:
    """One evaluation of all rules: (rule_id, grp, value, old_state, new_state).

    ``rules`` has the thresholds, comparator and no_data_action of each id; ``results``
    (rule_id, grp, value); ``previous`` (rule_id, grp, state). A known group without a
    result is without data, and so is a rule without any.
    """
    seen = results.join(previous, ["rule_id", "grp"], "full_outer")
    every = rules.join(seen, "rule_id", "left")
    old = F.coalesce("state", F.lit("ok"))
    state = next_state(old, F.col("value"), *(F.col(c) for c in ("critical", "critical_recovery", "warning", "warning_recovery", "comparator")))
    new = F.when(F.col("value").isNull() | F.isnan("value"), no_data_state(old, F.col("no_data_action"))).otherwise(state)
    return every.select("rule_id", F.coalesce("grp", F.lit("")).alias("grp"), "value", old.alias("old_state"), new.alias("new_state"))


def transitions(evaluated: DataFrame) -> DataFrame:
    """Events for the groups whose state has changed."""
    changed = evaluated.where("old_state <> new_state")
    message = F.concat_ws(" ", F.when(F.col("grp") != "", F.concat(F.col("grp"), F.lit(":"))), "old_state", F.lit("->"), "new_state", F.concat(F.lit("at "), F.format_number("value", 2)))
    return changed.withColumn("message", message)


def _in_order(values: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each group in one partition, in order: folds over it hold one batch and one state."""
    return values.repartition(*keys).sortWithinPartitions(*keys, order)


def _groups(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple]:
    """The keys of each row; null keys are None, which equals itself."""
    return zip(*(batch[k].astype(object).where(batch[k].notna(), None) for k in keys), strict=True)


RANK = {"ok": 0, "no_data": 1, "warn": 2, "alert": 3}


def worst_state(states: DataFrame, keys: list[str], state: str = "state") -> DataFrame:
    """The worst state of each rule's groups: alert, warn, no_data, ok."""
    rank = reduce(lambda a, kv: a.when(F.col(state) == kv[0], kv[1]), RANK.items(), F.when(F.lit(False), 0)).otherwise(0)
    return states.groupBy(*keys).agg(F.max_by(state, rank).alias("state"))


def composite(states: DataFrame, members: dict[str, str], formula: Callable[[dict[str, Column]], Column], key: str = "rule_id") -> DataFrame:
    """(alerting): a formula over member rules, given as letter -> rule id; a missing member is false.

    The formula is a function of Columns, such as ``lambda m: m["A"] & ~m["B"]``.
    """
    firing = [F.coalesce(F.bool_or((F.col(key) == rule) & (F.col("state") == "alert")), F.lit(False)).alias(letter) for letter, rule in members.items()]
    return states.agg(*firing).select(formula({letter: F.col(letter) for letter in members}).alias("alerting"))


# --------------------------------------------------------------- monitor values

AGGREGATES = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def metric_values(samples: DataFrame, aggregation: str = "avg", group_by: list[Column] = ()) -> DataFrame:
    """(grp, value): a metric over the window, by groups joined with ``:``."""
    key = F.concat_ws(":", *group_by) if group_by else F.lit("")
    return samples.groupBy(key.alias("grp")).agg(AGGREGATES[aggregation]("value").cast("double").alias("value"))


def log_values(logs: DataFrame, group_by: list[Column] = ()) -> DataFrame:
    key = F.concat_ws(":", *group_by) if group_by else F.lit("")
    return logs.groupBy(key.alias("grp")).agg(F.count("*").cast("double").alias("value"))


def apm_metric(name: str, window_s: float, approx: bool = True) -> Column:
    """error_rate (percent), error_count, request_rate (per second) or p50, p75, p90, p95, p99 (ms) of spans."""
    if name.startswith("p"):
        return percentile(milliseconds(), int(name[1:]) / 100, approx)
    return {"error_rate": F.count_if(is_error()) * 100.0 / F.count("*"), "error_count": F.count_if(is_error()).cast("double"), "request_rate": F.count("*") / float(window_s)}[name]


def apm_values(spans: DataFrame, metric: str, window_s: float, group_by: str = "service_name", approx: bool = True) -> DataFrame:
    return spans.groupBy(F.col(group_by).alias("grp")).agg(apm_metric(metric, window_s, approx).alias("value"))


def preview(df: DataFrame, start_s: int, end_s: int, value: Column, buckets: int = 10) -> DataFrame:
    """(bucket, value): the window cut into equal parts."""
    width = max((end_s - start_s) // buckets, 1)
    inside = df.where(F.unix_seconds("ts").between(start_s, end_s))
    part = F.least(F.floor((F.unix_seconds("ts") - start_s) / width), F.lit(buckets - 1))
    return inside.groupBy((F.lit(start_s) + part * width).cast("bigint").alias("bucket")).agg(value.alias("value"))


def series_values(series: DataFrame) -> DataFrame:
    """(grp, value): the last value of each series of an expression, without NaN."""
    last = series.groupBy("series_key").agg(F.first("labels").alias("labels"), F.max_by("value", "k").alias("value")).where(~F.isnan("value"))
    pairs = F.transform(F.array_sort(F.map_entries(F.map_filter("labels", lambda k, v: k != "__name__"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return last.select(F.array_join(pairs, ",").alias("grp"), "value")


# ---------------------------------------------------- service-level objectives

SLO_WINDOWS = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000}


def slo_traces(spans: DataFrame, keys: list[str], threshold_ms: float | None = None) -> DataFrame:
    """(keys, bad, total): failing spans, or those over a latency, in one scan."""
    bad = F.count_if(milliseconds() > threshold_ms) if threshold_ms is not None else F.count_if(is_error())
    return spans.groupBy(*keys).agg(bad.alias("bad"), F.count("*").alias("total"))


def slo_metric(samples: DataFrame, keys: list[str], errors: Column, total: Column) -> DataFrame:
    return samples.groupBy(*keys).agg(F.sum(F.when(errors, F.col("value")).otherwise(0.0)).alias("bad"), F.sum(F.when(total, F.col("value")).otherwise(0.0)).alias("total"))


def slo_histogram(points: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Slow requests from bucket counts: all but those of the buckets up to the threshold."""
    counted = F.filter(F.arrays_zip("bucket_counts", "explicit_bounds"), lambda b: b["explicit_bounds"] <= threshold)
    fast = F.aggregate(counted, F.lit(0).cast("bigint"), lambda a, b: a + b["bucket_counts"])
    return points.groupBy(*keys).agg(F.sum(F.greatest(F.col("count") - fast, F.lit(0))).alias("bad"), F.sum("count").alias("total"))


def slo_threshold(samples: DataFrame, keys: list[str], op: str, limit: float) -> DataFrame:
    v = F.col("value")
    good = {"lt": v < limit, "lte": v <= limit, "gt": v > limit, "gte": v >= limit}[op]
    return samples.groupBy(*keys).agg(F.count_if(~good).alias("bad"), F.count("*").alias("total"))


def budget(counts: DataFrame, target: float) -> DataFrame:
    """Add current_pct, remaining_pct and state (compliant, breached or no_data) for a target percentage."""
    allowed = 1 - target / 100
    bad = F.col("bad") / F.nullif(F.col("total").cast("double"), F.lit(0.0))
    left = F.lit(0.0) if allowed <= 0 else (allowed - bad) / allowed
    state = F.when(F.coalesce(F.col("total"), F.lit(0)) == 0, "no_data").when(left > 0, "compliant").otherwise("breached")
    return counts.withColumns({"current_pct": (1 - bad) * 100, "remaining_pct": F.when(bad.isNotNull(), left * 100), "state": state})


def slo_gauges(budgets: DataFrame, keys: list[str], at_ns: int) -> DataFrame:
    """Budgets as gauge rows, one for each number of each objective."""
    parts = {"current_pct": F.col("current_pct"), "remaining_pct": F.col("remaining_pct"), "errors": F.col("bad"), "total": F.col("total"), "compliant": F.when(F.col("state") == "compliant", 1).otherwise(0)}
    rows = F.array(*(F.struct(F.lit(f"slo.{n}").alias("metric_name"), c.cast("double").alias("value")) for n, c in parts.items()))
    labels = F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k).cast("string"))))
    return budgets.select(labels.alias("attributes"), F.lit(at_ns).cast("bigint").alias("ts_ns"), F.inline(rows))


# -------------------------------------------------------------------- anomalies


class Band:
    """Mean and variance of one series; twelve values warm it up. ``saved`` is all of it, for a store."""

    WARMUP = 12

    def __init__(self, sensitivity: float, alpha: float, saved: tuple[float, float, float, list[float] | None] = (0.0, 0.0, 0.0, [])):
        self.sensitivity, self.alpha = sensitivity, alpha
        self.mean, self.var, self.floor, warm = saved
        self.warm = None if warm is None else list(warm)
        self.deviation, self.hit = 0.0, False

    def saved(self) -> tuple[float, float, float, list[float] | None]:
        return self.mean, self.var, self.floor, self.warm

    def see(self, x: float) -> bool:
        """Fold one value; whether it was judged, which it is after the warm-up."""
        if self.warm is None:
            self._move(x, True)
            return True
        self.warm.append(x)
        if len(self.warm) == self.WARMUP:
            self._start()
        return False

    def _start(self) -> None:
        warm, self.warm = self.warm, None
        self.mean = sum(warm) / len(warm)
        self.var = sum((x - self.mean) ** 2 for x in warm) / len(warm)
        self.floor = 0.3 * self.var
        self.deviation = abs(warm[0] - self.mean) / self.var**0.5 if self.var > 0 else 0.0
        for x in warm[1:]:
            self._move(x, False)

    def _move(self, x: float, judged: bool) -> None:
        std, slow = self.var**0.5, self.alpha * 0.25
        self.hit = judged and (x > self.mean + self.sensitivity * std or x < max(self.mean - self.sensitivity * std, 0.0))
        if not self.hit:
            diff = x - self.mean
            self.mean = self.alpha * x + (1 - self.alpha) * self.mean
            self.var = max(slow * diff * diff + (1 - slow) * self.var, self.floor)
        self.deviation = abs(x - self.mean) / std if std > 0 else 0.0

    def verdict(self) -> tuple[float, bool, float]:
        if self.warm:
            self._start()
        return self.mean, self.hit, self.deviation


def _folded(values: DataFrame, keys: list[str], order: str, sensitivity: float, alpha: float, result: Callable[[Band], tuple], columns: list[StructField]) -> DataFrame:
    """A row for each series: what ``result`` takes from its band after its last value."""
    rows = values.select(*keys, F.col(order).alias("_at"), F.col("value").cast("double").alias("_v")).where("_v IS NOT NULL")
    fields = [f for f in rows.schema.fields if f.name in keys] + columns
    names = [f.name for f in fields]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, band = None, None
        for batch in batches:
            done = []
            for key, x in zip(_groups(batch, keys), batch["_v"], strict=True):
                if key != group:
                    if band:
                        done.append((*group, *result(band)))
                    group, band = key, Band(sensitivity, alpha)
                band.see(x)
            yield pd.DataFrame(done, columns=names)
        if band:
            yield pd.DataFrame([(*group, *result(band))], columns=names)

    return _in_order(rows, keys, "_at").drop("_at").mapInPandas(fold, StructType(fields))


def ewma_anomaly(values: DataFrame, keys: list[str], order: str, sensitivity: float = 3.0, alpha: float = 0.25) -> DataFrame:
    """(keys, mean, anomalous, deviation) of the last value of each series.

    A warm-up of twelve values gives the first mean and variance; later values outside
    of mean +- sensitivity * deviation (the lower edge not under zero) are anomalous and
    do not move the band. The variance moves a quarter as fast, and not under 0.3 of its
    start. The deviation of the last value is from the mean it has moved, in units of
    the deviation before. Null values are left out. Rows are folded as they come, in
    order, so a series may be of any length; the fold is not associative, so one task folds a series.
    """
    found = [StructField("mean", DoubleType()), StructField("anomalous", BooleanType()), StructField("deviation", DoubleType())]
    return _folded(values, keys, order, sensitivity, alpha, Band.verdict, found)


def ewma_bands(values: DataFrame, keys: list[str], order: str, sensitivity: float = 3.0, alpha: float = 0.25) -> DataFrame:
    """(keys, mean, var, floor, warm): the band of each series after its history, from which a stream can go on.

    ``warm`` holds the values of a series that is still warming up, and is null for the others.
    """
    found = [*(StructField(n, DoubleType()) for n in ("mean", "var", "floor")), StructField("warm", ArrayType(DoubleType()))]
    return _folded(values, keys, order, sensitivity, alpha, Band.saved, found)


def anomaly_verdict(scored: DataFrame, rule_keys: list[str], series: str) -> DataFrame:
    """(rule, anomalous, worst): whether any series is anomalous, and the one that deviates most."""
    return scored.groupBy(*rule_keys).agg(F.bool_or("anomalous").alias("anomalous"), F.max_by(series, F.struct("deviation", series)).alias("worst"), F.max("deviation").alias("deviation"))


def anomaly_step(window_s: int) -> int:
    """Seconds between evaluated points: finer for shorter windows."""
    return 15 if window_s <= 3600 else 60 if window_s <= 21600 else 300


# Suffixes of metrics that count up.
COUNTER_SUFFIXES = ("_total", "_count", "_sum", "_bucket", "_created")


def counter_like(metric: str) -> bool:
    """Whether a metric is read as a rate: by the suffix of its name."""
    return metric.endswith(COUNTER_SUFFIXES)


def auto_series(samples: DataFrame, metric: str, grid: series.Grid, by: list[str] = (), window_ms: int = 300_000) -> DataFrame:
    """The sum of a metric by labels, of its rate over five minutes if it counts up."""
    rows = samples.where(F.col("labels")["__name__"] == metric)
    read = series.range_function(rows, grid, window_ms, "rate") if counter_like(metric) else series.instant_select(rows, grid)
    return series.aggregate(read, "sum", by=list(by))


def apm_series(spans: DataFrame, seconds: int = 60, approx: bool = True) -> DataFrame:
    return spans.groupBy("service_name", bucket(seconds).alias("bucket")).agg(
        F.count("*").alias("total"), F.count_if(is_error()).alias("errors"), percentiles(milliseconds(), 0.5, 0.95, 0.99, approx=approx).alias("p")
    ).select("service_name", "bucket", "total", "errors", *(F.col("p")[i].alias(f"p{p}_ms") for i, p in enumerate((50, 95, 99))))


def correlate_event(spans: DataFrame, logs: DataFrame, at_s: int, pad_s: int = 300, services: int = 10) -> DataFrame:
    """Error logs near an anomaly of the services with most errors then: (service_name, errors, log_errors)."""
    near = lambda df: df.where(F.unix_seconds("ts").between(at_s - pad_s, at_s + pad_s))
    top = near(spans).groupBy("service_name").agg(F.count_if(is_error()).alias("errors"), F.count("*").alias("spans")).orderBy(F.desc("errors"), "service_name").limit(services)
    noisy = near(logs).where("severity_number >= 17").groupBy("service_name").agg(F.count("*").alias("log_errors"))
    return top.join(noisy, "service_name", "left").select("service_name", "spans", "errors", F.coalesce("log_errors", F.lit(0)).cast("bigint").alias("log_errors"))


def correlated_services(spans: DataFrame, at_s: int, status_code: int, pad_s: int = 300, services: int = 10) -> DataFrame:
    """(service_name, bucket, total, spans): minutes of the services with most spans of a status code near an anomaly."""
    near = spans.where(F.unix_seconds("ts").between(at_s - pad_s, at_s + pad_s) & (F.col("http_status_code") == status_code))
    top = near.groupBy("service_name").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "service_name").limit(services)
    minutes = near.groupBy("service_name", bucket(60).alias("bucket")).agg(F.count("*").alias("spans"))
    return minutes.join(F.broadcast(top), "service_name")  # as many rows as services


def correlated_logs(spans: DataFrame, logs: DataFrame, at_s: int, status_code: int, pad_s: int = 300, services: int = 10, limit: int | None = 200) -> DataFrame:
    """The logs near an anomaly of the services with most spans of its status code, newest first; all of them if ``limit`` is None."""
    top = correlated_services(spans, at_s, status_code, pad_s, services).select("service_name").distinct()
    found = logs.where(F.unix_seconds("ts").between(at_s - pad_s, at_s + pad_s)).join(F.broadcast(top), "service_name", "left_semi")
    report = found.select("ts", "service_name", "severity_text", "body", "trace_id")
    return report if limit is None else report.orderBy(F.desc("ts"), "service_name").limit(limit)


def correlation_buckets(spans: DataFrame, seconds: int = 60) -> DataFrame:
    """(service_name, bucket, codes): counts by status code, as text ``code=n``."""
    counted = spans.groupBy("service_name", bucket(seconds).alias("bucket"), "http_status_code").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("http_status_code", "n")))
    return counted.groupBy("service_name", "bucket").agg(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["http_status_code"].cast("string"), e["n"].cast("string"))), ",").alias("codes"))


# ------------------------------------------------------------------- detections

Tables = dict[str, DataFrame]


def _window(df: DataFrame, start, end) -> DataFrame:
    return df.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def _failed() -> Column:
    return F.count_if(is_error("status"))


def _slow(spans: DataFrame, keys: list[str], p99_ms: float, least: int, approx: bool = True) -> DataFrame:
    out = spans.groupBy(*keys).agg(percentile(milliseconds(), 0.99, approx).alias("p99_ms"), F.count("*").alias("total"))
    return out.where((F.col("p99_ms") > p99_ms) & (F.col("total") > least))


def brute_force(t: Tables, start, end, key: Column, failed: Column, least: int = 10) -> DataFrame:
    return _window(t["logs"], start, end).where(failed).groupBy(key.alias("source")).agg(F.count("*").alias("attempts")).where(F.col("attempts") >= least)


def error_rate_spike(t: Tables, start, end, rate: float = 0.05, least: int = 100) -> DataFrame:
    out = _window(t["spans"], start, end).groupBy("service_name").agg(_failed().alias("errors"), F.count("*").alias("total"))
    return out.where((F.col("total") > least) & (F.col("errors") > rate * F.col("total")))


def latency_regression(t: Tables, start, end, p99_ms: float = 500, least: int = 50, approx: bool = True) -> DataFrame:
    return _slow(_window(t["spans"], start, end).where("kind = 'SPAN_KIND_SERVER'"), ["service_name", "span_name"], p99_ms, least, approx)


def saturation(t: Tables, start, end, metric: str, host: Column, limit: float = 0.9) -> DataFrame:
    rows = _window(t["gauges"], start, end).where(F.col("metric_name") == metric)
    return rows.groupBy("service_name", host.alias("host")).agg(F.avg("value").alias("mean")).where(F.col("mean") > limit)


def rate_drop(t: Tables, start, end, before: str = "1 hour", least: float = 100, drop: float = 0.5, normalize: bool = False) -> DataFrame:
    """Both windows in one conditional pass. ``normalize`` compares rates where the windows differ in length."""
    at, stop, from_ = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.lit(start).cast("timestamp") - F.expr(f"INTERVAL {before}")
    scale = (F.unix_seconds(at) - F.unix_seconds(from_)) / (F.unix_seconds(stop) - F.unix_seconds(at)) if normalize else F.lit(1.0)
    total = lambda low, high: F.sum(F.when(F.col("ts").between(low, high), F.col("value")))
    both = t["sums"].where(F.col("ts").between(from_, stop)).groupBy("service_name").agg((total(at, stop) * scale).alias("current"), total(from_, at).alias("previous"))
    return both.withColumn("drop_pct", (F.col("previous") - F.col("current")) / F.nullif(F.col("previous"), F.lit(0.0))).where((F.col("previous") > least) & (F.col("drop_pct") > drop))


def errors_and_latency(t: Tables, start, end, rate: float = 0.05, p99_ms: float = 500, approx: bool = True) -> DataFrame:
    rows = _window(t["spans"], start, end)
    failing = rows.groupBy("service_name").agg(_failed().alias("errors"), F.count("*").alias("total")).where(F.col("errors") > rate * F.col("total"))
    return failing.select("service_name").join(_slow(rows.where("kind = 'SPAN_KIND_SERVER'"), ["service_name"], p99_ms, 0, approx), "service_name", "left_semi")


def severe_logs(t: Tables, start, end, least: int = 100) -> DataFrame:
    rows = _window(t["logs"], start, end).where(F.col("severity_text").isin("ERROR", "FATAL"))
    return rows.groupBy("service_name", "severity_text").agg(F.count("*").alias("total")).where(F.col("total") >= least)


def logs_and_traces(t: Tables, start, end, least: int = 5) -> DataFrame:
    noisy = _window(t["logs"], start, end).where(F.col("severity_text").isin("ERROR", "FATAL")).groupBy("service_name").agg(F.count("*").alias("log_errors")).where(F.col("log_errors") >= least)
    failing = _window(t["spans"], start, end).where(is_error("status")).groupBy("service_name").agg(F.count("*").alias("span_errors")).where(F.col("span_errors") >= least)
    return noisy.join(failing, "service_name")


def latency_and_memory(t: Tables, start, end, usage: Column, limit: Column, p99_ms: float = 500, least: int = 50, share: float = 0.85, approx: bool = True) -> DataFrame:
    slow = _slow(_window(t["spans"], start, end).where("http_status_code > 0"), ["service_name"], p99_ms, least, approx)
    rows = _window(t["gauges"], start, end)
    allowed = rows.where(limit).agg(F.min("value").alias("allowed"))  # one row
    pressed = rows.where(usage).groupBy("service_name").agg(F.max("value").alias("used")).join(F.broadcast(allowed)).where(F.col("used") > share * F.col("allowed"))
    return slow.join(pressed.select("service_name"), "service_name", "left_semi").select("service_name")


def post_deploy_errors(t: Tables, start, end, deploy: Column, minutes: int = 30, least: int = 20, rate: float = 0.05) -> DataFrame:
    """Deploys join spans of their service by an interval; one deploy a service keeps the join linear."""
    deploys = _window(t["spans"], start, end).where(deploy).groupBy("service_name").agg(F.max("ts").alias("deployed"))
    after = t["spans"].join(deploys, "service_name").where((F.col("ts") >= F.col("deployed")) & (F.col("ts") <= F.col("deployed") + F.expr(f"INTERVAL {minutes} MINUTES")))
    out = after.groupBy("service_name").agg(F.count_if(F.col("http_status_code") >= 500).alias("errors"), F.count("*").alias("total"))
    return out.where((F.col("total") > least) & (F.col("errors") > rate * F.col("total")))


def new_error_patterns(t: Tables, start, end, days: int = 7, least: int = 3) -> DataFrame:
    """(service_name, body, total): bodies are told apart by their digests, so that the days before send no texts."""
    severe = t["logs"].where(F.col("severity_text").isin("ERROR", "FATAL")).withColumn("_digest", F.sha2("body", 256))
    recent = _window(severe, start, end).groupBy("service_name", "_digest").agg(F.first("body").alias("body"), F.count("*").alias("total")).where(F.col("total") >= least)
    at = F.lit(start).cast("timestamp")
    earlier = severe.where((F.col("ts") >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < at)).select("service_name", "_digest").distinct()
    return recent.join(earlier, ["service_name", "_digest"], "left_anti").drop("_digest")


def cascading_failures(t: Tables, start, end, services: int = 3, rate: float = 0.1, least: int = 10) -> DataFrame:
    failing = _window(t["spans"], start, end).groupBy("service_name").agg(F.count_if(is_error()).alias("errors"), F.count("*").alias("total")).where((F.col("total") > least) & (F.col("errors") > rate * F.col("total")))
    return failing.agg(F.count("*").alias("failing")).where(F.col("failing") >= services)


def detect(rules: dict[str, tuple[Callable[[Tables], DataFrame], int]], tables: Tables) -> DataFrame:
    """(rule_id, matches): the rules whose query gives at least so many rows, in one job."""
    counted = [query(tables).agg(F.count("*").alias("matches")).select(F.lit(name).alias("rule_id"), "matches", F.lit(least).alias("least")) for name, (query, least) in rules.items()]
    return reduce(DataFrame.unionByName, counted).where("matches >= least").drop("least")


def detect_sql(spark, text: str, tables: Tables, tenant: str, **parameters) -> DataFrame:
    """A detection given as SQL over tenant-scoped views, with named parameters such as ``:window_start``."""
    return spark.sql(text, args=parameters, **{name: df.where(F.col("tenant_id") == tenant) for name, df in tables.items()})


def events_with_rule(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events with the name of their rule, also where the rule is gone."""
    return events.join(rules.select("rule_id", "rule_name"), "rule_id", "left").withColumn("rule_name", F.coalesce("rule_name", F.lit("deleted rule")))


def suppressed(events: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Events outside of all maintenance windows (starts, ends, scope), of every rule (``all``) or of their own; both sides may be large."""
    left = outside(events, maintenance.where("scope <> 'all'"), keys={"rule_id": "scope"})
    return outside(left, maintenance.where("scope = 'all'"))


def last_deploy(buckets: DataFrame, deploys: DataFrame) -> DataFrame:
    """``buckets`` with the time of the last deploy of their service before them."""
    both = buckets.select("service_name", "bucket", F.lit(None).cast("bigint").alias("deployed")).unionByName(deploys.select("service_name", F.col("deployed").alias("bucket"), "deployed"))
    so_far = Window.partitionBy("service_name").orderBy("bucket", F.col("deployed").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last_deploy", F.last("deployed", ignorenulls=True).over(so_far)).where("deployed IS NULL").drop("deployed")
