"""Many monitors and objectives at once: rules are rows, and each table is read once.

Signals are first added up to partial rows of a bucket, as a rollup stores them, so that what
meets the rules grows with series and time, not with rows; rules join the partial rows of
their metric or service and pick what they need from them. Every bound of a rule's window
must be a multiple of the buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.core import is_error, milliseconds
from tidewatch.operators import states
from tidewatch.operators.sketches import quantile

#: Columns of a rule table. ``metric`` names a metric, or what to take of spans (``APM_METRICS``); ``matchers``,
#: ``excluded`` and ``patterns`` are maps of labels to values, to unwanted values, and to regular expressions.
RULES = (
    "rule_id string, signal string, metric string, service string, matchers map<string,string>, excluded map<string,string>, patterns map<string,string>, aggregation string, group_by array<string>, window_s bigint, "
    "critical double, critical_recovery double, warning double, warning_recovery double, comparator string, no_data_action string"
)
APM_METRICS = ("error_rate", "error_count", "request_rate", "p50", "p75", "p90", "p95", "p99")


def _bucket(seconds: int) -> Column:
    return (F.floor(F.unix_seconds("ts") / seconds) * seconds).cast("bigint")


def metric_partials(samples: DataFrame, seconds: int = 60) -> DataFrame:
    """(name, labels, bucket, cnt, sum, min, max) of samples (metric_name, series_key, labels, ts, value)."""
    return samples.groupBy("metric_name", "series_key", _bucket(seconds).alias("bucket")).agg(
        F.any_value("labels").alias("labels"), F.count("value").alias("cnt"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")
    ).select(F.col("metric_name").alias("name"), "labels", "bucket", "cnt", "sum", "min", "max")


def span_partials(spans: DataFrame, seconds: int = 60, labels: dict[str, Column] | None = None, sketch: bool = True) -> DataFrame:
    """(name, labels, bucket, cnt, errors, sketch): spans by service and further labels; the sketch is of milliseconds."""
    named = {"service_name": F.col("service_name"), **(labels or {})}
    rows = spans.select(_bucket(seconds).alias("bucket"), is_error().alias("bad"), milliseconds().alias("ms"), *(c.cast("string").alias(f"l_{k}") for k, c in named.items()))
    keys = [f"l_{k}" for k in named]
    held = F.kll_sketch_agg_double("ms") if sketch else F.lit(None).cast("binary")
    grouped = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("cnt"), F.count_if("bad").alias("errors"), held.alias("sketch"))
    as_map = F.create_map(*(x for k in named for x in (F.lit(k), F.coalesce(f"l_{k}", F.lit("")))))
    return grouped.select(F.col("l_service_name").alias("name"), as_map.alias("labels"), "bucket", "cnt", "errors", "sketch")


def log_partials(logs: DataFrame, seconds: int = 60, labels: dict[str, Column] | None = None) -> DataFrame:
    """(name, labels, bucket, cnt): log rows by service, severity and further labels."""
    named = {"service_name": F.col("service_name"), "severity_text": F.col("severity_text"), **(labels or {})}
    rows = logs.select(_bucket(seconds).alias("bucket"), *(c.cast("string").alias(f"l_{k}") for k, c in named.items()))
    as_map = F.create_map(*(x for k in named for x in (F.lit(k), F.coalesce(f"l_{k}", F.lit("")))))
    grouped = rows.groupBy(*(f"l_{k}" for k in named), "bucket").agg(F.count("*").alias("cnt"))
    return grouped.select(F.col("l_service_name").alias("name"), as_map.alias("labels"), "bucket", "cnt")


def _label(key: Column) -> Column:
    return F.coalesce(F.try_element_at("labels", key), F.lit(""))


def matched(rules: DataFrame, partials: DataFrame, key: str, now_s: int) -> DataFrame:
    """Partial rows with each rule whose name, window and label matchers they fit, and ``grp``, their group in it.

    ``key`` is the rule's column that names what it reads; a null one reads everything. Null maps
    match everything, missing labels are empty, a group joins its label values with ``:``.
    """
    every = lambda column, test: F.coalesce(F.forall(F.map_entries(column), lambda e: test(_label(e["key"]), e["value"])), F.lit(True))
    fits = every("matchers", lambda a, b: a == b) & every("excluded", lambda a, b: a != b) & every("patterns", F.regexp_like)
    inside = (F.col("bucket") >= now_s - F.col("window_s")) & (F.col("bucket") < now_s)
    service = F.col("service").isNull() | (_label(F.lit("service_name")) == F.col("service"))
    # one row, known before the scan: the widest window bounds what is read, and only rules without a key need rows without one
    widest, open_ = rules.agg(F.max("window_s"), F.bool_or(F.col(key).isNull())).first()
    recent = partials.where((F.col("bucket") >= now_s - (widest or 0)) & (F.col("bucket") < now_s))
    names = F.explode(F.array("name", F.lit(None))) if open_ else F.col("name")
    joined = recent.withColumn("key_", names).join(rules, F.col("key_").eqNullSafe(F.col(key))).drop("key_")
    grp = F.array_join(F.transform(F.coalesce("group_by", F.array().cast("array<string>")), _label), ":")
    return joined.where(inside & service & fits).withColumn("grp", grp)


def metric_values(rules: DataFrame, partials: DataFrame, now_s: int) -> DataFrame:
    """(rule_id, grp, value) of rules on metrics: avg, sum, min, max or count of the window."""
    rows = matched(rules.where("signal = 'metric'"), partials, "metric", now_s).groupBy("rule_id", "grp", "aggregation").agg(F.sum("sum").alias("s"), F.sum("cnt").alias("n"), F.min("min").alias("low"), F.max("max").alias("high"))
    value = F.when(F.col("aggregation") == "avg", F.col("s") / F.nullif("n", F.lit(0))).when(F.col("aggregation") == "sum", F.col("s")).when(F.col("aggregation") == "min", F.col("low")).when(F.col("aggregation") == "max", F.col("high"))
    return rows.select("rule_id", "grp", F.when(F.col("aggregation") == "count", F.col("n").cast("double")).otherwise(value).alias("value"))


def span_values(rules: DataFrame, partials: DataFrame, now_s: int) -> DataFrame:
    """(rule_id, grp, value) of rules on spans: ``APM_METRICS`` of the window, percentiles from merged sketches."""
    rows = matched(rules.where("signal = 'spans'"), partials, "service", now_s).groupBy("rule_id", "grp", F.col("metric").alias("m"), "window_s").agg(F.sum("cnt").alias("n"), F.sum("errors").alias("bad"), F.kll_merge_agg_double(F.when(F.col("metric").startswith("p"), F.col("sketch"))).alias("sketch"))
    value = F.when(F.col("m") == "error_rate", F.col("bad") * 100.0 / F.col("n")).when(F.col("m") == "error_count", F.col("bad").cast("double")).when(F.col("m") == "request_rate", F.col("n") / F.col("window_s").cast("double"))
    marks = [m for m in APM_METRICS if m[0] == "p"]
    value = reduce(lambda v, m: v.when(F.col("m") == m, quantile("sketch", int(m[1:]) / 100)), marks, value)
    return rows.select("rule_id", "grp", value.alias("value"))


def log_values(rules: DataFrame, partials: DataFrame, now_s: int) -> DataFrame:
    """(rule_id, grp, value) of rules on logs: the number of rows in the window."""
    rows = matched(rules.where("signal = 'logs'"), partials, "service", now_s)
    return rows.groupBy("rule_id", "grp").agg(F.sum("cnt").cast("double").alias("value"))


def evaluate(rules: DataFrame, values: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(rule_id, grp, value, old_state, new_state) of all rules after this tick.

    A known group without a value is without data, and so is a rule without any group.
    """
    old = previous.select("rule_id", "grp", "state") if previous is not None else values.select("rule_id", "grp", F.lit("ok").alias("state"))
    seen = values.join(old, ["rule_id", "grp"], "full_outer")
    every = rules.join(seen, "rule_id", "left")
    state = F.coalesce("state", F.lit("ok"))
    code = states.step(*(F.col(c) for c in ("value", "critical", "critical_recovery", "warning", "warning_recovery", "comparator", "no_data_action")))
    return every.select("rule_id", F.coalesce("grp", F.lit("")).alias("grp"), "value", state.alias("old_state"), states.applied(code, state).alias("new_state"))


def fired(rules: DataFrame, values: DataFrame) -> DataFrame:
    """(rule_id, matches) of detections: rules with groups beyond their critical limit, and how many."""
    beyond = F.when(F.col("comparator") == "below", F.col("value") < F.col("critical")).otherwise(F.col("value") >= F.col("critical"))
    return values.join(rules.select("rule_id", "comparator", "critical"), "rule_id").where(beyond).groupBy("rule_id").agg(F.count("*").alias("matches"))


# ------------------------------------------------------------------- objectives


def objective_counts(objectives: DataFrame, spans: DataFrame, now_s: int, seconds: int = 3600) -> DataFrame:
    """(slo_id, bad, total) of (slo_id, service, threshold_ms, window_s), all in one scan of the spans.

    Without a threshold, failed spans are bad; with one, spans over it. A span meets the short
    sorted list of its service's thresholds, adds to one partial row by how many it is over, and
    objectives add up the partial rows from their own threshold on.
    """
    steps = objectives.where("threshold_ms IS NOT NULL").groupBy("service").agg(F.sort_array(F.collect_set("threshold_ms")).alias("limits"))
    widest = objectives.agg(F.max("window_s")).first()[0] or 0
    ms = milliseconds()
    rows = spans.select("service_name", _bucket(seconds).alias("bucket"), ms.alias("ms"), is_error().alias("bad")).where((F.col("bucket") >= now_s - widest) & (F.col("bucket") < now_s))
    ranked = rows.join(steps, F.col("service_name") == F.col("service"), "left").withColumn("over", F.size(F.filter(F.coalesce("limits", F.array().cast("array<double>")), lambda x: x < F.col("ms"))))
    partials = ranked.groupBy("service_name", "bucket", "over").agg(F.count("*").alias("n"), F.count_if("bad").alias("failed"))
    placed = objectives.join(steps, "service", "left").withColumn("place", F.array_position("limits", F.col("threshold_ms")))
    joined = placed.join(partials, (F.col("service") == F.col("service_name")) & (F.col("bucket") >= now_s - F.col("window_s")), "left")
    bad = F.when(F.col("threshold_ms").isNull(), F.col("failed")).when(F.col("over") >= F.col("place"), F.col("n"))
    return joined.groupBy("slo_id").agg(F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
