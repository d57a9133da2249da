"""Queries of monitors, objectives, anomalies, detections and metering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.core import bucket, is_error
from tidewatch.operators import rules, usage
from tidewatch.operators import series as ts
from tidewatch.sources import bind
from tidewatch.sources.bind import COUNTERS_SQL, LOGS_SQL, SAMPLES_SQL, SPANS_SQL, USAGE_SQL

QUERIES, ORACLES = {}, {}
W = ("2024-01-10 00:00:00", "2024-01-17 00:00:00")
IN = f"ts BETWEEN TIMESTAMP '{W[0]}' AND TIMESTAMP '{W[1]}'"
LOG_IN = f"ts_s BETWEEN epoch(TIMESTAMP '{W[0]}') AND epoch(TIMESTAMP '{W[1]}')"
DAY = "epoch_us(ts) // 86400000000 * 86400"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _tables(spark, sf_dir):
    gauges = bind.samples(spark, sf_dir)
    return {"spans": bind.spans(spark, sf_dir), "logs": bind.logs(spark, sf_dir), "gauges": gauges, "sums": gauges}


def _times(*tables):
    """The first and the last time of any row of the tables."""
    ts = reduce(DataFrame.unionByName, (t.select(F.unix_micros("ts").alias("us")) for t in tables))
    return [F.timestamp_micros(F.lit(us).cast("long")) for us in ts.agg(F.min("us"), F.max("us")).first()]


# ------------------------------------------------------------------ monitors


@query("monitor_metric_values", f"WITH {SAMPLES_SQL} SELECT service_name || ':' || shard AS grp, round(avg(value), 6) AS value FROM samples WHERE {IN} GROUP BY 1")
def monitor_metric_values(spark, sf_dir):
    rows = rules._window(bind.samples(spark, sf_dir), *W)
    return _round(rules.metric_values(rows, "avg", [F.col("service_name"), F.col("attributes")["shard"]]), "value")


@query("monitor_log_values", f"WITH {LOGS_SQL} SELECT service_name AS grp, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE severity_text = 'ERROR' GROUP BY 1")
def monitor_log_values(spark, sf_dir):
    return rules.log_values(bind.logs(spark, sf_dir).where("severity_text = 'ERROR'"), [F.col("service_name")])


_APM = {"error_rate": "count(*) FILTER (is_error) * 100.0 / count(*)", "error_count": "CAST(count(*) FILTER (is_error) AS DOUBLE)", "request_rate": "count(*) / 604800.0", **{f"p{p}": f"quantile_cont(duration_ns / 1e6, 0.{p})" for p in (50, 75, 90, 95, 99)}}


def _apm(metric):
    return lambda spark, sf_dir: _round(rules.apm_values(rules._window(bind.spans(spark, sf_dir), *W), metric, 604800, approx=False), "value")


for _m, _sql in _APM.items():
    QUERIES[f"monitor_apm_{_m}"] = _apm(_m)
    ORACLES[f"monitor_apm_{_m}"] = f"WITH {SPANS_SQL} SELECT service_name AS grp, round({_sql}, 6) AS value FROM spans WHERE {IN} GROUP BY 1"


@query("monitor_preview", f"WITH {SPANS_SQL} SELECT 1704844800 + least((epoch_us(ts) // 1000000 - 1704844800) // 60480, 9) * 60480 AS bucket, count(*) FILTER (is_error) AS value FROM spans WHERE epoch_us(ts) // 1000000 BETWEEN 1704844800 AND 1705449600 GROUP BY 1")
def monitor_preview(spark, sf_dir):
    return rules.preview(bind.spans(spark, sf_dir), 1704844800, 1705449600, F.count_if(is_error()))


@query("monitor_expression", f"""WITH {SAMPLES_SQL} SELECT 'service_name=' || service_name || ',shard=' || shard AS grp, round(max_by(value, ts_ms), 6) AS value FROM samples WHERE ts_ms BETWEEN 1705017600000 - 3600000 AND 1705017600000 GROUP BY 1""")
def monitor_expression(spark, sf_dir):
    return _round(rules.series_values(ts.instant_at(bind.samples(spark, sf_dir), 1705017600000, 3_600_000)), "value")


LIMITS = {"critical": 70.0, "critical_recovery": 55.0, "warning": 60.0, "warning_recovery": 50.0}
_STATE_SQL = f"""WITH RECURSIVE {SAMPLES_SQL}, v AS (SELECT service_name, {DAY} AS bucket, round(avg(value), 6) AS value, row_number() OVER (PARTITION BY service_name ORDER BY {DAY}) AS i FROM samples GROUP BY 1, 2),
s AS (SELECT service_name, bucket, value, i, CASE WHEN value >= 70 THEN 'alert' WHEN value >= 60 THEN 'warn' ELSE 'ok' END AS state FROM v WHERE i = 1
  UNION ALL SELECT v.service_name, v.bucket, v.value, v.i, CASE s.state WHEN 'ok' THEN CASE WHEN v.value >= 70 THEN 'alert' WHEN v.value >= 60 THEN 'warn' ELSE 'ok' END
    WHEN 'warn' THEN CASE WHEN v.value >= 70 THEN 'alert' WHEN v.value < 50 THEN 'ok' ELSE 'warn' END ELSE CASE WHEN v.value < 55 THEN CASE WHEN v.value >= 60 THEN 'warn' ELSE 'ok' END ELSE 'alert' END END FROM s JOIN v ON s.service_name = v.service_name AND v.i = s.i + 1)"""


def _daily(spark, sf_dir):
    return _round(bind.samples(spark, sf_dir).groupBy("service_name", bucket(86400).alias("bucket")).agg(F.avg("value").alias("value")), "value")


@query("monitor_states", f"{_STATE_SQL} SELECT service_name, bucket, value, state FROM s")
def monitor_states(spark, sf_dir):
    return rules.replay(_daily(spark, sf_dir), LIMITS, ["service_name"], "bucket")


@query("worst_state", f"{_STATE_SQL} SELECT service_name, CASE max(CASE state WHEN 'alert' THEN 3 WHEN 'warn' THEN 2 ELSE 0 END) WHEN 3 THEN 'alert' WHEN 2 THEN 'warn' ELSE 'ok' END AS state FROM s GROUP BY 1")
def worst_state(spark, sf_dir):
    return rules.worst_state(monitor_states(spark, sf_dir), ["service_name"])


def _rules(spark):
    return spark.createDataFrame(
        [("hot", 60.0, None, 50.0, None, "above", "notify"), ("cold", 45.0, None, None, None, "below", "resolve"), ("gone", 1.0, None, None, None, "above", "notify")],
        "rule_id string, critical double, critical_recovery double, warning double, warning_recovery double, comparator string, no_data_action string",
    )


def _evaluated(spark, sf_dir):
    values = _daily(spark, sf_dir).where("bucket = 1705363200").select(F.explode(F.array(F.lit("hot"), F.lit("cold"))).alias("rule_id"), F.col("service_name").alias("grp"), "value")
    previous = values.select("rule_id", "grp", F.when(F.col("grp") < "d", "alert").otherwise("ok").alias("state"))
    return rules.evaluate(_rules(spark), values, previous)


_EVAL_SQL = f"""WITH {SAMPLES_SQL}, v AS (SELECT service_name AS grp, round(avg(value), 6) AS value FROM samples WHERE {DAY} = 1705363200 GROUP BY 1), p AS (SELECT *, CASE WHEN grp < 'd' THEN 'alert' ELSE 'ok' END AS old_state FROM v),
x AS (SELECT 'hot' AS rule_id, grp, value, old_state, CASE WHEN old_state = 'alert' THEN CASE WHEN value < 60 THEN CASE WHEN value >= 50 THEN 'warn' ELSE 'ok' END ELSE 'alert' END WHEN value >= 60 THEN 'alert' WHEN value >= 50 THEN 'warn' ELSE 'ok' END AS new_state FROM p
UNION ALL SELECT 'cold', grp, value, old_state, CASE WHEN old_state = 'alert' THEN CASE WHEN value >= 45 THEN 'ok' ELSE 'alert' END WHEN value < 45 THEN 'alert' ELSE 'ok' END FROM p UNION ALL SELECT 'gone', '', NULL, 'ok', 'no_data')"""


@query("monitor_evaluate", f"{_EVAL_SQL} SELECT * FROM x")
def monitor_evaluate(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query("monitor_transitions", f"{_EVAL_SQL} SELECT rule_id, grp, old_state, new_state FROM x WHERE old_state <> new_state")
def monitor_transitions(spark, sf_dir):
    return rules.transitions(_evaluated(spark, sf_dir)).select("rule_id", "grp", "old_state", "new_state")


@query("composite_state", f"{_EVAL_SQL} SELECT bool_or(rule_id = 'hot' AND new_state = 'alert') OR NOT bool_or(rule_id = 'cold' AND new_state = 'alert') AS alerting FROM x")
def composite_state(spark, sf_dir):
    states = _evaluated(spark, sf_dir).withColumnRenamed("new_state", "state")
    return rules.composite(states, {"A": "hot", "B": "cold"}, lambda m: m["A"] | ~m["B"])


# -------------------------------------------------------------------- objectives

_BUDGET = "round((1 - bad / total) * 100, 6) AS current_pct, round((0.1 - bad / total) / 0.1 * 100, 4) AS remaining_pct, CASE WHEN (0.1 - bad / total) / 0.1 > 0 THEN 'compliant' ELSE 'breached' END AS state"


def _budget(counts):
    return _round(_round(rules.budget(counts, 90.0), "current_pct"), "remaining_pct", digits=4)


@query("slo_trace_availability", f"WITH {SPANS_SQL}, c AS (SELECT service_name, count(*) FILTER (is_error) AS bad, count(*) AS total FROM spans WHERE {IN} GROUP BY 1) SELECT service_name, bad, total, {_BUDGET} FROM c")
def slo_trace_availability(spark, sf_dir):
    return _budget(rules.slo_traces(rules._window(bind.spans(spark, sf_dir), *W), ["service_name"]))


@query("slo_trace_latency", f"WITH {SPANS_SQL}, c AS (SELECT service_name, count(*) FILTER (duration_ns / 1e6 > 120) AS bad, count(*) AS total FROM spans GROUP BY 1) SELECT service_name, bad, total, {_BUDGET} FROM c")
def slo_trace_latency(spark, sf_dir):
    return _budget(rules.slo_traces(bind.spans(spark, sf_dir), ["service_name"], 120.0))


@query("slo_metric_availability", f"WITH {SAMPLES_SQL}, c AS (SELECT shard, sum(CASE WHEN service_name = 'error' THEN value ELSE 0 END) AS bad, sum(value) AS total FROM samples GROUP BY 1) SELECT shard, round(bad, 4) AS bad, round(total, 4) AS total, {_BUDGET} FROM c")
def slo_metric_availability(spark, sf_dir):
    rows = bind.samples(spark, sf_dir).withColumn("shard", F.col("attributes")["shard"])
    return _round(_budget(rules.slo_metric(rows, ["shard"], F.col("service_name") == "error", F.lit(True))), "bad", "total", digits=4)


@query("slo_hist_latency", f"WITH c AS (SELECT event_type AS service_name, CAST(count(*) FILTER (value > 100) AS BIGINT) AS bad, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY 1) SELECT service_name, bad, total, {_BUDGET} FROM c")
def slo_hist_latency(spark, sf_dir):
    return _budget(rules.slo_histogram(bind.histograms(spark, sf_dir), ["service_name"], 100.0))


@query("slo_threshold", f"WITH {SAMPLES_SQL}, c AS (SELECT service_name, count(*) FILTER (NOT value <= 150) AS bad, count(*) AS total FROM samples GROUP BY 1) SELECT service_name, bad, total, {_BUDGET} FROM c")
def slo_threshold(spark, sf_dir):
    return _budget(rules.slo_threshold(bind.samples(spark, sf_dir), ["service_name"], "lte", 150.0))


@query("slo_gauges", f"WITH {SPANS_SQL}, c AS (SELECT service_name, CAST(count(*) FILTER (is_error) AS DOUBLE) AS bad, CAST(count(*) AS DOUBLE) AS total FROM spans GROUP BY 1) SELECT service_name, 'slo.errors' AS metric_name, bad AS value FROM c UNION ALL SELECT service_name, 'slo.total', total FROM c")
def slo_gauges(spark, sf_dir):
    rows = rules.slo_gauges(rules.budget(rules.slo_traces(bind.spans(spark, sf_dir), ["service_name"]), 90.0), ["service_name"], 0)
    return rows.where("metric_name IN ('slo.errors', 'slo.total')").select(F.col("attributes")["service_name"].alias("service_name"), "metric_name", "value")


# --------------------------------------------------------------------- anomalies

_EWMA_SQL = f"""WITH RECURSIVE {SAMPLES_SQL}, v AS (SELECT series_key, value AS x, row_number() OVER (PARTITION BY series_key ORDER BY ts_ms, value) AS i, count(*) OVER (PARTITION BY series_key) AS n FROM samples),
w AS (SELECT series_key, avg(x) AS m0, var_pop(x) AS v0, count(*) AS warm FROM v WHERE i <= 12 GROUP BY 1),
s AS (SELECT v.series_key, v.i, v.n, m0, v0, warm, m0 AS mean, v0 AS var, FALSE AS hit, abs(x - m0) / sqrt(v0) AS dev FROM v JOIN w USING (series_key) WHERE i = 1
  UNION ALL SELECT series_key, i, n, m0, v0, warm, CASE WHEN hit THEN mean ELSE 0.25 * x + 0.75 * mean END, CASE WHEN hit THEN var ELSE greatest(0.0625 * (x - mean) * (x - mean) + 0.9375 * var, 0.3 * v0) END, hit,
    abs(x - CASE WHEN hit THEN mean ELSE 0.25 * x + 0.75 * mean END) / sqrt(var)
  FROM (SELECT s.series_key, v.i, s.n, m0, v0, warm, s.mean, s.var, x, v.i > warm AND (x > s.mean + 3 * sqrt(s.var) OR x < greatest(s.mean - 3 * sqrt(s.var), 0)) AS hit FROM s JOIN v ON s.series_key = v.series_key AND v.i = s.i + 1)),
e AS (SELECT series_key, mean, hit AS anomalous, dev AS deviation FROM s WHERE i = n)"""


def _scored(spark, sf_dir):
    rows = bind.samples(spark, sf_dir).withColumn("at", F.struct("ts_ms", "value"))
    return rules.ewma_anomaly(rows, ["series_key"], "at")


@query("ewma_anomaly", f"{_EWMA_SQL} SELECT series_key, round(mean, 5) AS mean, anomalous, round(deviation, 5) AS deviation FROM e")
def ewma_anomaly(spark, sf_dir):
    return _round(_scored(spark, sf_dir), "mean", "deviation", digits=5)


@query("anomaly_verdict", f"{_EWMA_SQL} SELECT 'all' AS rule_id, bool_or(anomalous) AS anomalous, max_by(series_key, deviation) AS worst, round(max(deviation), 5) AS deviation FROM e")
def anomaly_verdict(spark, sf_dir):
    return _round(rules.anomaly_verdict(_scored(spark, sf_dir).withColumn("rule_id", F.lit("all")), ["rule_id"], "series_key"), "deviation", digits=5)


@query(
    "anomaly_apm_series",
    f"WITH {SPANS_SQL} SELECT service_name, epoch_us(ts) // 3600000000 * 3600 AS bucket, count(*) AS total, count(*) FILTER (is_error) AS errors, round(quantile_cont(duration_ns / 1e6, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ns / 1e6, 0.95), 6) AS p95_ms, round(quantile_cont(duration_ns / 1e6, 0.99), 6) AS p99_ms FROM spans GROUP BY 1, 2",
)
def anomaly_apm_series(spark, sf_dir):
    return _round(rules.apm_series(bind.spans(spark, sf_dir), 3600, approx=False), "p50_ms", "p95_ms", "p99_ms")


@query("correlate_event", f"WITH {SPANS_SQL}, {LOGS_SQL}, n AS (SELECT service_name, count(*) AS spans, count(*) FILTER (is_error) AS errors FROM spans WHERE epoch_us(ts) // 1000000 BETWEEN 1704067200 AND 1704110400 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 3) SELECT service_name, spans, errors, CAST(0 AS BIGINT) AS log_errors FROM n")
def correlate_event(spark, sf_dir):
    return rules.correlate_event(bind.spans(spark, sf_dir), bind.logs(spark, sf_dir), 1704088800, 21600, 3)


_NEAR = "BETWEEN 1704067200 AND 1704110400"
_TOP = f"n AS (SELECT service_name, count(*) AS total FROM spans WHERE epoch_us(ts) // 1000000 {_NEAR} AND http_status_code = 500 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)"


@query("correlated_services", f"WITH {SPANS_SQL}, {_TOP} SELECT service_name, epoch_us(ts) // 60000000 * 60 AS bucket, total, count(*) AS spans FROM spans JOIN n USING (service_name) WHERE epoch_us(ts) // 1000000 {_NEAR} AND http_status_code = 500 GROUP BY ALL")
def correlated_services(spark, sf_dir):
    return rules.correlated_services(bind.spans(spark, sf_dir), 1704088800, 500, 21600, 3)


@query("correlated_logs", f"WITH {SPANS_SQL}, {LOGS_SQL}, {_TOP} SELECT ts_s, split_part('click,error,purchase,signup,view', ',', CAST(ts_s // 60 % 5 AS INT) + 1) AS service_name, severity_text, body FROM logs WHERE ts_s {_NEAR} AND split_part('click,error,purchase,signup,view', ',', CAST(ts_s // 60 % 5 AS INT) + 1) IN (SELECT service_name FROM n)")
def correlated_logs(spark, sf_dir):
    """The logs dealt among the services of the spans."""
    names = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    rows = bind.logs(spark, sf_dir).withColumn("service_name", F.get(names, (F.floor(F.unix_seconds("ts") / 60) % 5).cast("int")))
    return rules.correlated_logs(bind.spans(spark, sf_dir), rows, 1704088800, 500, 21600, 3, None).select(F.unix_seconds("ts").alias("ts_s"), "service_name", "severity_text", "body")


@query("correlation_buckets", f"WITH {SPANS_SQL}, c AS (SELECT service_name, {DAY} AS bucket, http_status_code AS code, count(*) AS n FROM spans GROUP BY 1, 2, 3) SELECT service_name, bucket, string_agg(code || '=' || n, ',' ORDER BY code) AS codes FROM c GROUP BY 1, 2")
def correlation_buckets(spark, sf_dir):
    return rules.correlation_buckets(bind.spans(spark, sf_dir), 86400)


# -------------------------------------------------------------------- detections


@query("detect_brute_force", f"WITH {LOGS_SQL} SELECT service_name AS source, count(*) AS attempts FROM logs WHERE severity_text = 'WARN' GROUP BY 1 HAVING count(*) >= 10")
def detect_brute_force(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    return rules.brute_force(tables, *_times(tables["logs"]), F.col("service_name"), F.col("severity_text") == "WARN")


@query("detect_error_rate_spike", f"WITH {SPANS_SQL} SELECT service_name, count(*) FILTER (status = 'STATUS_CODE_ERROR') AS errors, count(*) AS total FROM spans WHERE {IN} GROUP BY 1 HAVING count(*) > 100 AND errors > 0.05 * count(*)")
def detect_error_rate_spike(spark, sf_dir):
    return rules.error_rate_spike(_tables(spark, sf_dir), *W)


@query("detect_latency_regression", f"WITH {SPANS_SQL} SELECT service_name, span_name, round(quantile_cont(duration_ns / 1e6, 0.99), 6) AS p99_ms, count(*) AS total FROM spans WHERE {IN} AND kind = 'SPAN_KIND_SERVER' GROUP BY 1, 2 HAVING p99_ms > 200 AND total > 50")
def detect_latency_regression(spark, sf_dir):
    return _round(rules.latency_regression(_tables(spark, sf_dir), *W, p99_ms=200, approx=False), "p99_ms")


@query("detect_saturation", f"WITH {SAMPLES_SQL} SELECT service_name, shard AS host, round(avg(value), 6) AS mean FROM samples WHERE {IN} GROUP BY 1, 2 HAVING avg(value) > 50")
def detect_saturation(spark, sf_dir):
    return _round(rules.saturation(_tables(spark, sf_dir), *W, "app.value", F.col("attributes")["shard"], 50.0), "mean")


@query(
    "detect_rate_drop",
    f"WITH {SAMPLES_SQL}, c AS (SELECT service_name, sum(value) FILTER (ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10 12:00:00') AS current, sum(value) FILTER (ts BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-10') AS previous FROM samples GROUP BY 1) SELECT service_name, round(current, 4) AS current, round(previous, 4) AS previous, round((previous - current) / previous, 6) AS drop_pct FROM c WHERE previous > 100 AND (previous - current) / previous > 0.3",
)
def detect_rate_drop(spark, sf_dir):
    return _round(_round(rules.rate_drop(_tables(spark, sf_dir), "2024-01-10 00:00:00", "2024-01-10 12:00:00", "24 hours", drop=0.3), "current", "previous", digits=4), "drop_pct")


@query("detect_errors_and_latency", f"WITH {SPANS_SQL} SELECT service_name FROM spans WHERE {IN} GROUP BY 1 HAVING count(*) FILTER (status = 'STATUS_CODE_ERROR') > 0.05 * count(*) AND quantile_cont(duration_ns / 1e6, 0.99) FILTER (kind = 'SPAN_KIND_SERVER') > 100")
def detect_errors_and_latency(spark, sf_dir):
    return rules.errors_and_latency(_tables(spark, sf_dir), *W, p99_ms=100, approx=False)


@query("detect_severe_logs", f"WITH {LOGS_SQL} SELECT service_name, severity_text, count(*) AS total FROM logs WHERE severity_text IN ('ERROR', 'FATAL') GROUP BY 1, 2 HAVING count(*) >= 20")
def detect_severe_logs(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    return rules.severe_logs(tables, *_times(tables["logs"]), 20)


@query("detect_logs_and_traces", f"WITH {SPANS_SQL}, {LOGS_SQL}, l AS (SELECT service_name, count(*) AS log_errors FROM logs WHERE severity_text IN ('ERROR', 'FATAL') GROUP BY 1 HAVING count(*) >= 5), s AS (SELECT 'src' || CAST(k % 20 AS VARCHAR) AS service_name, count(*) AS span_errors FROM spans WHERE status = 'STATUS_CODE_ERROR' GROUP BY 1 HAVING count(*) >= 5) SELECT * FROM l JOIN s USING (service_name)")
def detect_logs_and_traces(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    named = tables["spans"].withColumn("service_name", F.concat(F.lit("src"), (F.col("attributes")["k"].cast("int") % 20).cast("string")))
    return rules.logs_and_traces(tables | {"spans": named}, *_times(tables["logs"], tables["spans"]))


@query("detect_latency_and_memory", f"WITH {SPANS_SQL}, {SAMPLES_SQL} SELECT service_name FROM spans WHERE {IN} GROUP BY 1 HAVING quantile_cont(duration_ns / 1e6, 0.99) > 100 AND count(*) > 50 AND service_name IN (SELECT service_name FROM samples WHERE {IN} GROUP BY 1 HAVING max(value) > 0.85 * (SELECT min(value) FROM samples WHERE {IN} AND value > 200))")
def detect_latency_and_memory(spark, sf_dir):
    return rules.latency_and_memory(_tables(spark, sf_dir), *W, usage=F.col("metric_name") == "app.value", limit=F.col("value") > 200, p99_ms=100, approx=False)


@query(
    "detect_post_deploy_errors",
    f"WITH {SPANS_SQL}, d AS (SELECT service_name, max(ts) AS deployed FROM spans WHERE {IN} AND k >= 90 GROUP BY 1) SELECT service_name, count(*) FILTER (http_status_code >= 500) AS errors, count(*) AS total FROM spans JOIN d USING (service_name) WHERE ts >= deployed AND ts <= deployed + INTERVAL 2880 MINUTE GROUP BY 1 HAVING count(*) > 20 AND count(*) FILTER (http_status_code >= 500) > 0.05 * count(*)",
)
def detect_post_deploy_errors(spark, sf_dir):
    return rules.post_deploy_errors(_tables(spark, sf_dir), *W, deploy=F.col("attributes")["k"].cast("int") >= 90, minutes=2880)


@query("detect_new_error_patterns", f"WITH {LOGS_SQL}, r AS (SELECT service_name, body, count(*) AS total FROM logs WHERE severity_text IN ('ERROR', 'FATAL') AND ts_s BETWEEN 1704067200 + 6 * 3600 AND 1704067200 + 20 * 3600 GROUP BY 1, 2), h AS (SELECT service_name, body FROM logs WHERE severity_text IN ('ERROR', 'FATAL') AND ts_s < 1704067200 + 6 * 3600) SELECT service_name, sha256(body) AS body, total FROM r WHERE (service_name, body) NOT IN (SELECT (service_name, body) FROM h)")
def detect_new_error_patterns(spark, sf_dir):
    found = rules.new_error_patterns(_tables(spark, sf_dir), "2024-01-01 06:00:00", "2024-01-01 20:00:00", least=1)
    return found.withColumn("body", F.sha2("body", 256))


@query("detect_cascading_failures", f"WITH {SPANS_SQL}, f AS (SELECT service_name FROM spans WHERE {IN} GROUP BY 1 HAVING count(*) > 10 AND count(*) FILTER (is_error) > 0.03 * count(*)) SELECT count(*) AS failing FROM f HAVING count(*) >= 3")
def detect_cascading_failures(spark, sf_dir):
    return rules.cascading_failures(_tables(spark, sf_dir), *W, rate=0.03)


@query("detect_all", f"WITH {SPANS_SQL}, {LOGS_SQL} SELECT 'errors' AS rule_id, count(*) AS matches FROM (SELECT service_name FROM spans WHERE {IN} GROUP BY 1 HAVING count(*) > 100 AND count(*) FILTER (status = 'STATUS_CODE_ERROR') > 0.05 * count(*)) UNION ALL SELECT 'noise', count(*) FROM (SELECT service_name, severity_text FROM logs WHERE severity_text IN ('ERROR', 'FATAL') GROUP BY 1, 2 HAVING count(*) >= 5)")
def detect_all(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    period = _times(tables["logs"])
    queries = {"errors": (lambda t: rules.error_rate_spike(t, *W), 1), "noise": (lambda t: rules.severe_logs(t, *period, 5), 1), "never": (lambda t: rules.severe_logs(t, *period, 10**9), 1)}
    return rules.detect(queries, tables)


@query("detect_sql", f"WITH {SPANS_SQL} SELECT service_name, count(*) AS total FROM spans WHERE tenant_id = 't1' AND {IN} GROUP BY 1")
def detect_sql(spark, sf_dir):
    text = "SELECT service_name, count(*) AS total FROM {spans} WHERE ts BETWEEN CAST(:window_start AS TIMESTAMP) AND CAST(:window_end AS TIMESTAMP) GROUP BY 1"
    return rules.detect_sql(spark, text, {"spans": bind.spans(spark, sf_dir)}, "t1", window_start=W[0], window_end=W[1])


@query("threshold_count", f"WITH {SPANS_SQL}, {LOGS_SQL} SELECT (SELECT count(*) FROM spans) + (SELECT count(*) FROM logs) AS total, TRUE AS fires")
def threshold_count(spark, sf_dir):
    from tidewatch.functions.core import threshold

    total = usage.count_across([bind.spans(spark, sf_dir), bind.logs(spark, sf_dir)])
    return total.withColumn("fires", threshold(F.col("total").cast("double"), ">", 100.0))


@query("events_with_rule", "SELECT o_orderkey AS event_id, coalesce(c_name, 'deleted rule') AS rule_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def events_with_rule(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("rule_id"))
    named = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("rule_id"), F.col("c_name").alias("rule_name"))
    return rules.events_with_rule(found, named).select("event_id", "rule_name")


@query("maintenance_suppressed", f"WITH {SPANS_SQL} SELECT service_name AS rule_id, count(*) AS total FROM spans WHERE NOT ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AND NOT (service_name = 'click' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20') GROUP BY 1")
def maintenance_suppressed(spark, sf_dir):
    windows = spark.createDataFrame([("2024-01-05", "2024-01-06", "all"), ("2024-01-10", "2024-01-20", "click")], "a string, b string, scope string").select(F.col("a").cast("timestamp").alias("starts"), F.col("b").cast("timestamp").alias("ends"), "scope")
    found = bind.spans(spark, sf_dir).select(F.col("service_name").alias("rule_id"), "ts")
    return rules.suppressed(found, windows).groupBy("rule_id").agg(F.count("*").alias("total"))


@query("last_deploy", f"WITH {SPANS_SQL}, b AS (SELECT DISTINCT service_name, {DAY} AS bucket FROM spans), d AS (SELECT service_name, epoch_us(ts) // 1000000 AS dep FROM spans WHERE k >= 98) SELECT service_name, bucket, coalesce((SELECT max(dep) FROM d WHERE d.service_name = b.service_name AND dep <= bucket), 0) AS last_deploy FROM b")
def last_deploy(spark, sf_dir):
    rows = bind.spans(spark, sf_dir)
    deploys = rows.where(F.col("attributes")["k"].cast("int") >= 98).select("service_name", F.unix_seconds("ts").alias("deployed"))
    found = rules.last_deploy(rows.select("service_name", bucket(86400).alias("bucket")).distinct(), deploys)
    return found.withColumn("last_deploy", F.coalesce("last_deploy", F.lit(0)))


# ---------------------------------------------------------------------- metering


@query("usage_summary", f"WITH {USAGE_SQL} SELECT signal, CAST(sum(events_count) AS BIGINT) AS events, CAST(sum(bytes_count) AS BIGINT) AS bytes FROM usage GROUP BY 1")
def usage_summary(spark, sf_dir):
    return usage.usage_summary(bind.tenant_usage(spark, sf_dir))


@query("usage_tenants", f"WITH {USAGE_SQL} SELECT tenant_id, CAST(sum(events_count) FILTER (signal = 'traces') AS BIGINT) AS traces, CAST(sum(events_count) FILTER (signal = 'logs') AS BIGINT) AS logs, CAST(sum(events_count) FILTER (signal = 'rum') AS BIGINT) AS rum, CAST(sum(events_count) AS BIGINT) AS events FROM usage GROUP BY 1")
def usage_tenants(spark, sf_dir):
    return usage.usage_by_tenant(bind.tenant_usage(spark, sf_dir), ["traces", "logs", "rum"])


@query("usage_breakdown", f"WITH {USAGE_SQL} SELECT bucket // 86400 * 86400 AS bucket, signal, CAST(sum(events_count) AS BIGINT) AS events, CAST(sum(bytes_count) AS BIGINT) AS bytes FROM usage GROUP BY 1, 2")
def usage_breakdown(spark, sf_dir):
    return usage.usage_breakdown(bind.tenant_usage(spark, sf_dir))


@query("signal_totals", f"WITH {SPANS_SQL} SELECT 'spans' AS signal, count(*) AS total, count(*) FILTER (epoch_us(ts) // 1000000 > 1706486400 - 86400) AS recent, round(count(*) FILTER (epoch_us(ts) // 1000000 > 1706486400 - 86400) / 86400.0, 6) AS per_second, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-29') AS today FROM spans")
def signal_totals(spark, sf_dir):
    return _round(usage.signal_totals({"spans": bind.spans(spark, sf_dir)}, F.timestamp_seconds(F.lit(1706486400)), 86400), "per_second")


@query("series_count", f"WITH {SAMPLES_SQL} SELECT count(DISTINCT series_key) AS series FROM samples")
def series_count(spark, sf_dir):
    return usage.series_count(bind.samples(spark, sf_dir), exact=True)


@query("metric_cardinality", f"WITH {SAMPLES_SQL} SELECT metric_name, count(DISTINCT series_key) AS series, CAST(1 AS INT) AS labels FROM samples GROUP BY 1")
def metric_cardinality(spark, sf_dir):
    rows = bind.samples(spark, sf_dir)
    return usage.metric_cardinality([rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")], exact=True)


@query("label_cardinality", f"WITH {SAMPLES_SQL} SELECT 'shard' AS label, count(DISTINCT shard) AS distinct_values FROM samples UNION ALL SELECT 'service_name', count(DISTINCT service_name) FROM samples")
def label_cardinality(spark, sf_dir):
    return usage.label_cardinality(bind.samples(spark, sf_dir), "app.value")


@query("unused_metrics", "SELECT DISTINCT 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, 'm.' || event_type AS metric_name FROM events WHERE event_type <> 'click' AND NOT (event_type = 'view' AND user_id % 3 = 1)")
def unused_metrics(spark, sf_dir):
    e = bind.events(spark, sf_dir)
    named = e.select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.concat(F.lit("m."), "event_type").alias("metric_name"), "event_type")
    queried = named.where("event_type = 'click' OR (event_type = 'view' AND tenant_id = 't1')").select("tenant_id", F.col("metric_name").alias("signal_name"))
    return usage.unused_metrics([named.where("event_type < 'f'"), named.where("event_type >= 'f'")], queried)


@query("tracked_signals", "SELECT 't0' AS tenant_id, event_type AS signal_name, count(*) AS query_count, max(epoch_us(ts)) AS last_us, max(ts) >= TIMESTAMP '2024-01-25' AS recent FROM events GROUP BY 2")
def tracked_signals(spark, sf_dir):
    from pyspark.sql import Window

    e = bind.events(spark, sf_dir)
    seen = F.row_number().over(Window.partitionBy("event_type").orderBy("ts")).cast("bigint")
    log = e.select(F.lit("t0").alias("tenant_id"), F.col("event_type").alias("signal_name"), F.lit("metric").alias("signal_type"), F.lit("ui").alias("source"), F.col("ts").alias("last_queried_at"), seen.alias("query_count"))
    out = usage.tracked_signals(log, F.lit("2024-01-30").cast("timestamp"), 5)
    return out.select("tenant_id", "signal_name", "query_count", F.unix_micros("last_queried_at").alias("last_us"), "recent")
