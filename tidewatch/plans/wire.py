"""Queries over wire shapes, stored tables and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import predicates as P
from tidewatch.functions.core import scratch
from tidewatch.operators import explore, rum, services, usage
from tidewatch.operators import normalize as nz
from tidewatch.operators import series as ts
from tidewatch.plans.metrics import GRID, INSTANT_SQL, _shown
from tidewatch.sources import bind, tables
from tidewatch.sources.bind import LOGS_SQL, RUM_SQL, SAMPLES_SQL, SPANS_SQL, USAGE_SQL

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: Events with the number of their properties and nanoseconds.
EVENTS_SQL = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) * 1000 AS ts_ns FROM events)"


def _events(spark, sf_dir):
    return bind.events(spark, sf_dir).withColumn("ts_ns", F.unix_micros("ts") * 1000)


def _text(key, value):
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


# ---------------------------------------------------------------- stored tables

_FROM, _TO = "2024-01-10", "2024-01-20"
_IN = "ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"


def _stored(spark, signal, rows, tenant="t1"):
    """Rows written as a stored table and scanned again for one tenant and ten days."""
    root = scratch(spark, f"stored-{signal}")
    tables.append(rows, root, signal)
    return tables.scan(spark, root, signal, tenant, _FROM, _TO)


@query("scan_spans", f"WITH {SPANS_SQL} SELECT service_name, count(*) AS total, CAST(sum(duration_ns) AS BIGINT) AS busy, count(DISTINCT trace_id) AS traces FROM spans WHERE tenant_id = 't1' AND {_IN} GROUP BY 1")
def scan_spans(spark, sf_dir):
    rows = _stored(spark, "spans", bind.spans(spark, sf_dir))
    return rows.groupBy("service_name").agg(F.count("*").alias("total"), F.sum("duration_ns").alias("busy"), F.countDistinct("trace_id").alias("traces"))


@query("scan_spans_raw", f"WITH {SPANS_SQL} SELECT span_id, span_name, duration_ns FROM spans WHERE tenant_id = 't1' AND {_IN}")
def scan_spans_raw(spark, sf_dir):
    raw = bind.spans(spark, sf_dir).withColumnsRenamed({"kind": "span_kind", "status": "status_code", "attributes": "span_attributes"})
    return _stored(spark, "spans_raw", raw).select("span_id", "span_name", "duration_ns")


@query("scan_logs", f"WITH {LOGS_SQL} SELECT severity_text, count(*) AS total, CAST(sum(length(body)) AS BIGINT) AS chars FROM logs WHERE tenant_id = 't1' AND make_timestamp(ts_s * 1000000) BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1")
def scan_logs(spark, sf_dir):
    root = scratch(spark, "stored-logs")
    tables.append(bind.logs(spark, sf_dir), root, "logs")
    rows = tables.scan(spark, root, "logs", "t1", "2024-01-01", "2024-01-01 12:00:00")
    return rows.groupBy("severity_text").agg(F.count("*").alias("total"), F.sum(F.char_length("body")).alias("chars"))


_BAD = "w AS (SELECT DISTINCT trace_id FROM spans WHERE http_status_code = 404 AND CAST(ts AS DATE) = DATE '2024-01-12')"


@query("trace_fetch", f"WITH {SPANS_SQL}, {_BAD} SELECT trace_id, span_id FROM spans JOIN w USING (trace_id)")
def trace_fetch(spark, sf_dir):
    """All spans of some traces of a stored table, read from the dates of those traces alone."""
    root = scratch(spark, "stored-traces")
    tables.append(bind.spans(spark, sf_dir), root, "spans")
    rows = spark.read.parquet(f"{root}/spans")
    wanted = rows.where("http_status_code = 404 AND date = '2024-01-12'").select("trace_id").distinct()
    return services.trace_spans(rows, wanted, services.trace_index(rows)).select("trace_id", "span_id")


@query("trace_projection", f"WITH {SPANS_SQL}, {_BAD} SELECT tenant_id, trace_id, ts_ns, duration_ns, service_name FROM spans JOIN w USING (trace_id)")
def trace_projection(spark, sf_dir):
    """The projection written by ranges of traces, and looked up by trace."""
    raw = bind.spans(spark, sf_dir)
    path = scratch(spark, "by-trace")
    tables.store_by_trace(nz.trace_projection(raw), path)
    wanted = raw.where("http_status_code = 404 AND CAST(ts AS DATE) = '2024-01-12'").select("trace_id").distinct()
    return spark.read.parquet(path).join(wanted, "trace_id", "left_semi").select("tenant_id", "trace_id", "ts_ns", "duration_ns", "service_name")


@query("scan_rum", f"WITH {RUM_SQL} SELECT event_type, count(*) AS total, count(DISTINCT session_id) AS sessions FROM rum WHERE CAST(user_id AS INT) % 3 = 1 AND {_IN} GROUP BY 1")
def scan_rum(spark, sf_dir):
    return _stored(spark, "rum", bind.rum(spark, sf_dir).drop("event_id")).groupBy("event_type").agg(F.count("*").alias("total"), F.countDistinct("session_id").alias("sessions"))


@query("scan_rum_replay", f"WITH {RUM_SQL} SELECT session_id, count(*) AS chunks FROM rum WHERE CAST(user_id AS INT) % 3 = 1 AND {_IN} GROUP BY 1")
def scan_rum_replay(spark, sf_dir):
    chunks = bind.rum(spark, sf_dir).select("tenant_id", "session_id", "app_name", F.col("event_id").cast("int").alias("chunk_idx"), F.col("ts").alias("chunk_ts"), F.lit("[]").alias("events_json"))
    return _stored(spark, "rum_replay", chunks).groupBy("session_id").agg(F.count("*").alias("chunks"))


# ------------------------------------------------------------------- metrics in JSON


def _metric_records(spark, sf_dir):
    """Metric records of all five kinds, read back from JSON by schema.

    Every event is a record with its gauge and its sum, as a client sends it; the points of a service
    by hours are a record a day, those by days a record a month. No record grows with the events.
    """
    e = _events(spark, sf_dir)
    about = F.array(_text("shard", F.col("user_id") % 5))
    example = F.struct(F.array(_text("k", F.col("k"))).alias("filteredAttributes"), F.col("ts_ns").alias("timeUnixNano"), F.col("value").alias("asDouble"), F.hex("event_id").alias("spanId"), F.lit("").alias("traceId"))
    common = [about.alias("attributes"), F.col("ts_ns").alias("timeUnixNano")]
    gauge = F.struct(*common, F.col("value").alias("asDouble"), F.array(example).alias("exemplars"))
    whole = F.struct(*common, F.col("k").cast("bigint").alias("asInt"))
    shape = [F.count("*").alias("count"), F.sum(F.col("k").cast("double")).alias("sum")]
    day = F.unix_seconds(F.date_trunc("day", "ts")) * 1_000_000_000
    daily = e.groupBy("event_type", day.alias("timeUnixNano")).agg(*shape, *(F.count_if(F.col("k") % 3 == i).alias(f"b{i}") for i in range(3)), F.max("k").cast("double").alias("most"))
    buckets = F.array("b0", "b1", "b2")
    hour = bind.histograms(spark, sf_dir).select(F.col("service_name").alias("event_type"), (F.col("hour") * 1_000_000_000).cast("bigint").alias("timeUnixNano"), "count", "sum", F.col("bucket_counts").alias("bucketCounts"), F.col("explicit_bounds").alias("explicitBounds"))
    histogram = F.struct("timeUnixNano", "count", "sum", "bucketCounts", "explicitBounds")
    exponential = F.struct("timeUnixNano", "count", "sum", F.lit(3).alias("scale"), F.col("b0").alias("zeroCount"), F.struct(F.lit(1).alias("offset"), buckets.alias("bucketCounts")).alias("positive"))
    summary = F.struct("timeUnixNano", "count", "sum", F.array(F.struct(F.lit(1.0).alias("quantile"), F.col("most").alias("value"))).alias("quantileValues"))
    at = F.timestamp_seconds(F.expr("timeUnixNano div 1000000000"))
    listed = lambda rows, point, unit: rows.groupBy("event_type", F.date_trunc(unit, at)).agg(F.collect_list(point).alias("points"))

    def texts(rows, **points):
        data = {kind: F.struct(p.alias("dataPoints"), *(F.lit(v).alias(k) for k, v in extra.items())) for kind, (p, extra) in points.items()}
        # each metric has a field for the data of every kind of the record, so that they are of one type
        metrics = [F.struct(F.lit(f"app.{kind}").alias("name"), F.lit("ms").alias("unit"), *(F.when(F.lit(k == kind), d).alias(k) for k, d in data.items())) for kind in data]
        resource = F.struct(F.array(_text("service.name", F.col("event_type"))).alias("attributes"))
        record = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(*metrics).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
        return rows.select(F.to_json(record).alias("value"))

    sent = [
        texts(e, gauge=(F.array(gauge), {}), sum=(F.array(whole), {"aggregationTemporality": 2, "isMonotonic": True})),
        texts(listed(hour, histogram, "day"), histogram=(F.col("points"), {"aggregationTemporality": 1})),
        texts(listed(daily, exponential, "month"), exponentialHistogram=(F.col("points"), {"aggregationTemporality": 2})),
        texts(listed(daily, summary, "month"), summary=(F.col("points"), {})),
    ]
    return reduce(DataFrame.unionByName, sent).select(F.from_json("value", nz.METRIC_RECORDS).alias("r")).select("r.*")


def _metric_table(spark, sf_dir, name):
    return nz.metrics(_metric_records(spark, sf_dir), "t1")[name]


@query("normalize_gauges", f"WITH {EVENTS_SQL} SELECT event_type AS service_name, 'app.gauge' AS metric_name, CAST(user_id % 5 AS VARCHAR) AS shard, ts_ns, value, hex(event_id) AS example, CAST(k AS VARCHAR) AS example_k FROM e")
def normalize_gauges(spark, sf_dir):
    rows = _metric_table(spark, sf_dir, "metrics_gauge")
    one = F.col("exemplars")[0]
    return rows.select("service_name", "metric_name", F.col("attributes")["shard"].alias("shard"), "ts_ns", "value", one["span_id"].alias("example"), one["attributes"]["k"].alias("example_k"))


@query("normalize_sums", f"WITH {EVENTS_SQL} SELECT event_type AS service_name, count(*) AS points, CAST(sum(k) AS DOUBLE) AS value, 2 AS temporality, true AS monotonic FROM e GROUP BY 1")
def normalize_sums(spark, sf_dir):
    rows = _metric_table(spark, sf_dir, "metrics_sum")
    return rows.groupBy("service_name").agg(F.count("*").alias("points"), F.sum("value").alias("value"), F.max("aggregation_temporality").alias("temporality"), F.bool_and("is_monotonic").alias("monotonic"))


@query("normalize_histograms", "SELECT event_type AS service_name, epoch_us(ts) // 3600000000 * 3600000000000 AS ts_ns, count(*) AS count, count(*) FILTER (value <= 10) AS first_bucket, count(*) FILTER (value > 200) AS last_bucket, 5 AS bounds FROM events GROUP BY 1, 2")
def normalize_histograms(spark, sf_dir):
    rows = _metric_table(spark, sf_dir, "metrics_histogram")
    return rows.select("service_name", "ts_ns", "count", F.col("bucket_counts")[0].alias("first_bucket"), F.element_at("bucket_counts", -1).alias("last_bucket"), F.size("explicit_bounds").alias("bounds"))


@query("normalize_exp_histograms", f"WITH {EVENTS_SQL} SELECT event_type AS service_name, count(*) AS count, count(*) FILTER (k % 3 = 0) AS zero_count, count(*) FILTER (k % 3 = 2) AS last_bucket, 3 AS scale, ts_ns // 86400000000000 AS day FROM e GROUP BY 1, 6")
def normalize_exp_histograms(spark, sf_dir):
    rows = _metric_table(spark, sf_dir, "metrics_exp_histogram")
    return rows.select("service_name", "count", "zero_count", F.element_at("positive_bucket_counts", -1).alias("last_bucket"), "scale", F.expr("ts_ns div 86400000000000").alias("day"))


@query("normalize_summaries", f"WITH {EVENTS_SQL} SELECT event_type AS service_name, count(*) AS count, CAST(max(k) AS DOUBLE) AS most, ts_ns // 86400000000000 AS day FROM e GROUP BY 1, 4")
def normalize_summaries(spark, sf_dir):
    rows = _metric_table(spark, sf_dir, "metrics_summary")
    return rows.select("service_name", "count", F.col("quantiles")[0]["value"].alias("most"), F.expr("ts_ns div 86400000000000").alias("day"))


for _table, _sql in (
    ("metrics_gauge", "count(*) AS points"), ("metrics_sum", "count(*) AS points"), ("metrics_histogram", "count(DISTINCT ts_ns // 3600000000000) AS points"),
    ("metrics_exp_histogram", "count(DISTINCT ts_ns // 86400000000000) AS points"), ("metrics_summary", "count(DISTINCT ts_ns // 86400000000000) AS points"),
):
    _start = "ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'" if _table in ("metrics_gauge", "metrics_sum") else "date_trunc('hour', ts) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'" if _table == "metrics_histogram" else "date_trunc('day', ts) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"

    @query(f"scan_{_table}", f"WITH {EVENTS_SQL} SELECT event_type AS service_name, {_sql} FROM e WHERE {_start} GROUP BY 1")
    def _scan_metrics(spark, sf_dir, name=_table):
        return _stored(spark, name, _metric_table(spark, sf_dir, name)).groupBy("service_name").agg(F.count("*").alias("points"))


# ---------------------------------------------------------------------- other shapes


@query("any_values", f"""WITH {EVENTS_SQL} SELECT event_id, CAST(k AS VARCHAR) AS number, CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS flag, '[' || CAST(k AS VARCHAR) || ',x]' AS list, '{{a=' || event_type || ',b=' || CAST(k AS VARCHAR) || '}}' AS pairs, 'last' AS twice,
    '[[' || CAST(k AS VARCHAR) || '],{{q=[' || event_type || ',deep]}}]' AS nested FROM e""")
def any_values(spark, sf_dir):
    value = lambda **v: F.struct(*(c.alias(n) for n, c in v.items()))
    k = F.col("k").cast("bigint")
    one = lambda key, v: F.to_json(F.struct(F.lit(key).alias("key"), v.alias("value")))
    entry = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
    parts = [
        one("number", value(intValue=k)), one("flag", value(boolValue=k % 2 == 0)), one("twice", value(stringValue=F.lit("first"))), one("twice", value(stringValue=F.lit("last"))),
        one("list", value(arrayValue=F.struct(F.array(value(intValue=k, stringValue=F.lit(None).cast("string")), value(intValue=F.lit(None).cast("bigint"), stringValue=F.lit("x"))).alias("values")))),
        one("pairs", value(kvlistValue=F.struct(F.array(entry("a", value(stringValue=F.col("event_type"), intValue=F.lit(None).cast("bigint"))), entry("b", value(stringValue=F.lit(None).cast("string"), intValue=k))).alias("values")))),
    ]
    # text, since the levels of a list have as many types: a list of a list and of pairs, which hold a list
    deep = """{"key":"nested","value":{"arrayValue":{"values":[{"arrayValue":{"values":[{"intValue":%d}]}},{"kvlistValue":{"values":[{"key":"q","value":{"arrayValue":{"values":[{"stringValue":"%s"},{"stringValue":"deep"}]}}}]}}]}}}"""
    parts.append(F.format_string(deep, k, F.col("event_type")))
    texts = _events(spark, sf_dir).select("event_id", F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("value"))
    read = texts.select("event_id", nz.attributes(F.from_json("value", nz.ATTRS)).alias("a"))
    return read.select("event_id", *(F.col("a")[c].alias(c) for c in ("number", "flag", "list", "pairs", "twice", "nested")))


@query("normalize_logs", "SELECT doc_id, source AS service_name, text AS body, lang, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE doc_id + 1 END AS ts_ns, CASE WHEN doc_id % 10 = 0 THEN 'ERROR' ELSE '' END AS severity_text, CASE WHEN doc_id % 10 = 0 THEN 17 ELSE 0 END AS severity_number FROM documents")
def normalize_logs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bad = F.col("doc_id") % 10 == 0
    at = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") + 1).otherwise(0)).cast("bigint")
    seen = F.when(F.col("doc_id") % 3 == 2, F.col("doc_id") + 1).otherwise(0).cast("bigint")
    log = F.struct(at.alias("timeUnixNano"), seen.alias("observedTimeUnixNano"), F.when(bad, 17).alias("severityNumber"), F.when(bad, "ERROR").alias("severityText"), F.struct(F.col("text").alias("stringValue")).alias("body"), F.array(_text("lang", F.col("lang")), _text("id", F.col("doc_id"))).alias("attributes"))
    resource = F.struct(F.array(_text("service.name", F.col("source"))).alias("attributes"))
    record = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(log).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    out = nz.logs(d.select(F.from_json(F.to_json(record), nz.LOG_RECORDS).alias("r")).select("r.*"), "t0", 5)
    return out.select(F.col("log_attributes")["id"].cast("bigint").alias("doc_id"), "service_name", "body", F.col("log_attributes")["lang"].alias("lang"), "ts_ns", "severity_text", "severity_number")


@query("normalize_shipper_logs", "SELECT doc_id, source AS service_name, text AS body, CASE WHEN lang = 'de' THEN 'ERROR' WHEN lang = 'fr' THEN 'FATAL' WHEN lang = 'es' THEN 'DEBUG' ELSE 'INFO' END AS severity_text, 'h' || CAST(doc_id % 4 AS VARCHAR) AS host FROM documents")
def normalize_shipper_logs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    level = F.when(F.col("lang") == "de", "err").when(F.col("lang") == "fr", "CRITICAL").when(F.col("lang") == "es", "debug").otherwise("note")
    line = F.to_json(F.struct(F.col("text").alias("message"), level.alias("level"), F.col("source").alias("service"), F.concat(F.lit("h"), (F.col("doc_id") % 4).cast("string")).alias("host"), F.col("doc_id").cast("string").alias("number")))
    lines = d.select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line).alias("value"))
    out = nz.shipper_logs(lines, "t0", 5)
    return out.select(F.col("log_attributes")["number"].cast("bigint").alias("doc_id"), "service_name", "body", "severity_text", F.col("resource_attributes")["host.name"].alias("host"))


def _series_rows(spark, sf_dir):
    e = _events(spark, sf_dir)
    tags = F.array(F.concat(F.lit("service:"), F.col("event_type")), F.concat(F.lit("shard:"), (F.col("user_id") % 5).cast("string")), F.lit("flag"))
    kind = F.when(F.col("event_type") == "view", "count").when(F.col("event_type") == "error", "2").otherwise("gauge")
    point = F.struct(F.unix_seconds("ts").alias("timestamp"), F.col("value").alias("value"))
    return e.select("event_id", F.concat(F.lit("app."), "event_type").alias("metric"), kind.alias("type"), F.concat(F.lit("h"), (F.col("k") % 2).cast("string")).alias("host"), tags.alias("tags"), F.array(point).alias("points"), "k", "ts")


@query("normalize_agent_metrics", f"WITH {EVENTS_SQL} SELECT 'app.' || event_type AS metric_name, event_type AS service_name, CASE WHEN event_type IN ('view', 'error') THEN 'sum' ELSE 'gauge' END AS kind, CAST(user_id % 5 AS VARCHAR) AS shard, 'h' || CAST(k % 2 AS VARCHAR) AS host, epoch_us(ts) // 1000000 * 1000000000 AS ts_ns, value FROM e")
def normalize_agent_metrics(spark, sf_dir):
    out = nz.agent_metrics(_series_rows(spark, sf_dir), "t0")
    return out.select("metric_name", "service_name", "kind", F.col("attributes")["shard"].alias("shard"), F.col("attributes")["host.name"].alias("host"), "ts_ns", "value")


@query("normalize_agent_sums", f"WITH {EVENTS_SQL} SELECT event_type AS service_name, count(*) AS points, 2 AS temporality, true AS monotonic FROM e WHERE event_type IN ('view', 'error') GROUP BY 1")
def normalize_agent_sums(spark, sf_dir):
    sums = nz.gauge_to_sum(nz.agent_metrics(_series_rows(spark, sf_dir), "t0").where("kind = 'sum'"))
    return sums.groupBy("service_name").agg(F.count("*").alias("points"), F.max("aggregation_temporality").alias("temporality"), F.bool_and("is_monotonic").alias("monotonic"))


@query("normalize_service_checks", f"WITH {EVENTS_SQL} SELECT 'dd.check.' || event_type AS metric_name, 'h' || CAST(k % 2 AS VARCHAR) AS host, CAST(k % 4 AS DOUBLE) AS value, epoch_us(ts) // 1000000 * 1000000000 AS ts_ns FROM e")
def normalize_service_checks(spark, sf_dir):
    rows = _series_rows(spark, sf_dir).select(F.substring_index("metric", ".", -1).alias("check"), (F.col("k") % 4).alias("status"), "host", "tags", F.unix_seconds("ts").alias("timestamp"))
    return nz.service_checks(rows, "t0").select("metric_name", F.col("attributes")["host.name"].alias("host"), "value", "ts_ns")


@query("normalize_rum_batches", f"WITH {RUM_SQL} SELECT session_id, app_name, event_type, count(*) AS total FROM rum GROUP BY ALL")
def normalize_rum_batches(spark, sf_dir):
    rows = bind.rum(spark, sf_dir)
    batches = rows.groupBy(F.struct("app_name", "session_id").alias("meta")).agg(F.collect_list(F.struct("event_type", "page_path", "event_id")).alias("events"))
    return nz.rum_events(batches, "t0").groupBy("session_id", "app_name", "event_type").agg(F.count("*").alias("total"))


@query("rum_synthetic_spans", f"WITH {RUM_SQL} SELECT lpad(lower(hex(event_id)), 16, '0') AS span_id, app_name AS service_name, event_type || ' ' || page_path AS span_name, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, session_id AS session FROM rum WHERE event_id % 2 = 0")
def rum_synthetic_spans(spark, sf_dir):
    hexed = F.lpad(F.lower(F.hex("event_id")), 16, "0")
    rows = bind.rum(spark, sf_dir).withColumns({"trace_id": F.when(F.col("event_id") % 2 == 0, F.concat(hexed, hexed)).otherwise(""), "span_id": hexed})
    return rum.synthetic_spans(rows).select("span_id", "service_name", "span_name", "status", F.get_json_object("attributes", "$['rum.session_id']").alias("session"))


@query("rum_replay_sessions", f"WITH {RUM_SQL} SELECT DISTINCT session_id FROM rum")
def rum_replay_sessions(spark, sf_dir):
    return rum.replay_sessions(bind.rum(spark, sf_dir))


@query("rum_filter", f"WITH {RUM_SQL} SELECT browser_name, count(*) AS total FROM rum WHERE event_type = 'pageview' AND duration_ms > 20 GROUP BY 1")
def rum_filter(spark, sf_dir):
    test = P.where([("EventType", "=", "pageview"), ("durationMs", ">", 20)], P.rum_field)
    return bind.rum(spark, sf_dir).where(test).groupBy("browser_name").agg(F.count("*").alias("total"))


# ------------------------------------------------------------------ searches and lookups


@query("metric_filter", f"WITH {SAMPLES_SQL} SELECT service_name, count(*) AS total FROM samples WHERE shard IN ('1', '3') AND value > 30 AND metric_name LIKE 'app%' GROUP BY 1")
def metric_filter(spark, sf_dir):
    test = P.where([("attributes.shard", "IN", "1, 3"), ("value", ">", 30), ("metric_name", "LIKE", "app%")], P.metric_field)
    return bind.samples(spark, sf_dir).where(test).groupBy("service_name").agg(F.count("*").alias("total"))


@query("metric_seconds", f"WITH {SAMPLES_SQL} SELECT service_name, count(*) AS total FROM samples WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11 12:00:00' GROUP BY 1")
def metric_seconds(spark, sf_dir):
    rows = bind.samples(spark, sf_dir).where(P.between_seconds("2024-01-10 00:00:00.5", "2024-01-11 12:00:00.9"))
    return rows.groupBy("service_name").agg(F.count("*").alias("total"))


@query("span_search", f"WITH {SPANS_SQL} SELECT span_id FROM spans WHERE (lower(span_name) LIKE '%view%2%' AND http_path LIKE '%/p/1%') OR k = 17 OR span_id = '0000000000000007' OR user_id = 12 OR CAST(user_id AS VARCHAR) LIKE '3%'")
def span_search(spark, sf_dir):
    found = P.span_search([["VIEW*2", "/p/1"], ["k=17"], ["0000000000000007"], ["user.id=12"], ["user.id=3*"]])
    return bind.spans(spark, sf_dir).where(found).select("span_id")


@query("span_search_blob", f"""WITH {SPANS_SQL} SELECT service_name, count(*) AS total FROM spans WHERE contains('"k":"' || CAST(k AS VARCHAR) || '"', '"k":"4') GROUP BY 1""")
def span_search_blob(spark, sf_dir):
    return bind.spans(spark, sf_dir).where(P.span_search([['"K":"4']])).groupBy("service_name").agg(F.count("*").alias("total"))


_COMPLETE = {
    "metric": ("samples", "app", None, f"WITH {SAMPLES_SQL} SELECT DISTINCT metric_name AS value FROM samples"),
    "label_key": ("samples", "", None, "SELECT 'shard' AS value FROM events LIMIT 1"),
    "label_value": ("samples", "", "shard", f"WITH {SAMPLES_SQL} SELECT DISTINCT shard AS value FROM samples"),
    "endpoint": ("spans", "/p", None, f"WITH {SPANS_SQL} SELECT DISTINCT http_path AS value FROM spans"),
}
for _kind, (_source, _prefix, _key, _sql) in _COMPLETE.items():

    @query(f"autocomplete_{_kind}", _sql)
    def _complete(spark, sf_dir, kind=_kind, source=_source, start=_prefix, key=_key):
        return explore.autocomplete([getattr(bind, source)(spark, sf_dir)], kind, start, key)


@query("usage_merge", f"WITH {USAGE_SQL} SELECT tenant_id, signal, bucket, CAST(sum(events_count) AS BIGINT) AS events_count, CAST(sum(bytes_count) AS BIGINT) AS bytes_count FROM (SELECT * FROM usage UNION ALL SELECT * FROM usage) GROUP BY 1, 2, 3")
def usage_merge(spark, sf_dir):
    rows = bind.tenant_usage(spark, sf_dir)
    merged = usage.merge_usage(rows.unionByName(rows))
    return merged.select("tenant_id", "signal", F.unix_seconds("bucket").alias("bucket"), "events_count", "bytes_count")


@query("usage_gauges", "SELECT 'spans' AS signal, 'signals.total' AS metric_name, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'logs', 'signals.total', CAST(count(*) AS DOUBLE) FROM documents")
def usage_gauges(spark, sf_dir):
    totals = usage.signal_totals({"spans": bind.spans(spark, sf_dir), "logs": bind.logs(spark, sf_dir)}, F.lit("2024-01-30").cast("timestamp"), 3600)
    rows = usage.stats_gauges(totals, 5).where("metric_name = 'signals.total'")
    return rows.select(F.col("attributes")["signal"].alias("signal"), "metric_name", "value")


# ---------------------------------------------------------------- series algebra


def _mean_compared(op):
    def run(spark, sf_dir):
        one = ts.scalar(ts.with_scalar(ts.instant_select(bind.samples(spark, sf_dir), GRID), "/", 5.0), "ceil")
        return _shown(ts.binary(one, ts.scalar(ts.aggregate(one, "avg", by=["service_name"]), "floor"), op, on=["service_name"], group="left"), 5)

    return run


for _name, _op in (("gt", ">"), ("le", "<=")):
    QUERIES[f"bin_{_name}_mean"] = _mean_compared(_op)
    ORACLES[f"bin_{_name}_mean"] = f"""WITH {SAMPLES_SQL}, {INSTANT_SQL}, c AS (SELECT series_key, service_name, k, ceil(value / 5.0) AS x FROM inst), m AS (SELECT service_name, k, floor(avg(x)) AS r FROM c GROUP BY 1, 2)
    SELECT '{{"service_name":"' || service_name || '","shard":"' || shard || '"}}' AS series_key, k, x AS value FROM (SELECT c.*, r, shard FROM c JOIN m USING (service_name, k) JOIN (SELECT DISTINCT series_key, shard FROM inst) USING (series_key)) WHERE x {_op} r"""


@query(
    "bin_group_right",
    f"""WITH {SAMPLES_SQL}, {INSTANT_SQL}, m AS (SELECT service_name, k, sum(value) AS s FROM inst GROUP BY 1, 2)
    SELECT '{{"service_name":"' || service_name || '","shard":"' || shard || '","team":"' || CASE service_name WHEN 'view' THEN 'web' ELSE 'core' END || '"}}' AS series_key, k, round(s / value, 5) AS value FROM inst JOIN m USING (service_name, k) WHERE value <> 0""",
)
def bin_group_right(spark, sf_dir):
    rows = ts.instant_select(bind.samples(spark, sf_dir), GRID).where("value <> 0")
    team = F.when(F.col("labels")["service_name"] == "view", "web").otherwise("core")
    one = ts.aggregate(ts.instant_select(bind.samples(spark, sf_dir), GRID), "sum", by=["service_name"])
    one = one.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("team"), team)))
    return _shown(ts.binary(one, rows, "/", on=["service_name"], group="right", include=["team"]), 5)


@query("instant_one_step", f"WITH {SAMPLES_SQL} SELECT series_key, 0 AS k, round(max_by(value, ts_ms), 6) AS value FROM samples WHERE ts_ms BETWEEN 1704499200000 - 3600000 AND 1704499200000 + 3600000 GROUP BY 1")
def instant_one_step(spark, sf_dir):
    at = 1_704_499_200_000
    return _shown(ts.instant_select(bind.samples(spark, sf_dir), ts.Grid(at, at + 3_600_000, 3_600_001)))


# ---------------------------------------------------------------------- exports


def _daily(spark, sf_dir):
    rows = bind.spans(spark, sf_dir)
    return rows.groupBy("service_name", F.date_trunc("day", "ts").alias("ts")).agg(F.count("*").alias("total"), F.max("duration_ns").alias("slowest"))


@query("export_csv", f"WITH {SPANS_SQL} SELECT service_name, strftime(ts, '%Y-%m-%d') || 'T00:00:00.000000Z' AS ts, CAST(count(*) AS VARCHAR) AS total FROM (SELECT service_name, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts FROM spans) GROUP BY 1, 2")
def export_csv(spark, sf_dir):
    """A table of days, exported with some of its columns and read back as text."""
    path = scratch(spark, "export-csv")
    tables.export_csv(_daily(spark, sf_dir), path, ["service_name", "ts", "total"], max_rows=tables.MOST_ROWS, note={"query": "daily"})
    return spark.read.option("header", True).csv(path)


@query("export_json", f"WITH {SPANS_SQL} SELECT 'daily' AS query, CAST(count(*) AS BIGINT) AS rows, FALSE AS truncated, CAST(sum(total) AS BIGINT) AS total FROM (SELECT count(*) AS total FROM spans GROUP BY service_name, CAST(ts AS DATE))")
def export_json(spark, sf_dir):
    """The envelope of an export, with the rows that it is about."""
    path = scratch(spark, "export-json")
    tables.export_json(_daily(spark, sf_dir), path, tables.MOST_ROWS, {"query": "daily"})
    side = spark.read.schema("query string, rows bigint, truncated boolean").json(path + "_query")
    return side.join(F.broadcast(spark.read.json(path).agg(F.sum("total").alias("total"))))  # one row each
