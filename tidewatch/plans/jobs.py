"""Queries of normalisation, retention and streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tidewatch.operators import normalize as nz
from tidewatch.operators import retention, rollup, rules
from tidewatch.plans.rules import _EWMA_SQL
from tidewatch.sources import bind
from tidewatch.sources.bind import LOGS_SQL, SAMPLES_SQL, SPANS_SQL
from tidewatch.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------------------------- normalising


def _json_spans(spark, sf_dir):
    """The spans as trace records in JSON, one record a trace, read back by schema."""
    s = bind.spans(spark, sf_dir)
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    span = F.struct(
        F.upper("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("span_name").alias("name"), F.when(F.col("kind") == "SPAN_KIND_SERVER", 2).otherwise(3).alias("kind"),
        F.col("ts_ns").alias("startTimeUnixNano"), (F.col("ts_ns") + F.col("duration_ns")).alias("endTimeUnixNano"), F.struct(F.when(F.col("status") == "STATUS_CODE_ERROR", 2).otherwise(1).alias("code")).alias("status"),
        F.array(text("http.method", F.col("http_method")), text("http.route", F.col("http_path")), text("http.status_code", F.col("http_status_code").cast("string"))).alias("attributes"),
    )
    per_service = s.groupBy("trace_id", "service_name").agg(F.collect_list(span).alias("spans"))
    resource = F.struct(F.array(text("service.name", F.col("service_name"))).alias("attributes"))
    record = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.col("spans").alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return per_service.select(F.from_json(F.to_json(record), nz.SPAN_RECORDS).alias("r")).select("r.*")


@query("normalize_traces", f"WITH {SPANS_SQL} SELECT trace_id, span_id, parent_span_id, service_name, span_name, kind AS span_kind, status AS status_code, ts_ns, duration_ns FROM spans")
def normalize_traces(spark, sf_dir):
    raw = nz.spans_raw(_json_spans(spark, sf_dir), "t0")
    return raw.select("trace_id", "span_id", "parent_span_id", "service_name", "span_name", "span_kind", "status_code", "ts_ns", "duration_ns")


@query("flatten_spans", f"WITH {SPANS_SQL} SELECT span_id, http_method, http_path, http_status_code, kind, status FROM spans")
def flatten_spans(spark, sf_dir):
    return nz.wide_spans(nz.spans_raw(_json_spans(spark, sf_dir), "t0")).select("span_id", "http_method", "http_path", "http_status_code", "kind", "status")


_SEVERITY = "CASE WHEN contains(text, ' ERROR ') OR contains(text, ' error ') THEN 'ERROR' WHEN contains(text, ' WARN ') OR contains(text, ' WARNING ') OR contains(text, ' warn ') THEN 'WARN' WHEN contains(text, ' DEBUG ') OR contains(text, ' debug ') THEN 'DEBUG' WHEN contains(text, ' FATAL ') OR contains(text, ' fatal ') OR contains(text, ' CRITICAL ') THEN 'FATAL' WHEN contains(text, ' INFO ') OR contains(text, ' info ') THEN 'INFO' WHEN lang = 'de' THEN 'WARN' WHEN lang = 'fr' THEN 'ERROR' ELSE 'INFO' END"


@query("normalize_agent_logs", f"SELECT doc_id * 1000000000 + 1704067200000000000 AS ts_ns, source AS service_name, {_SEVERITY} AS severity_text, source AS environment, lang AS label FROM documents")
def normalize_agent_logs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select(
        F.col("text").alias("message"), F.when(F.col("lang") == "de", "warning").when(F.col("lang") == "fr", "err").otherwise("").alias("status"), F.col("source").alias("service"), F.lit("h").alias("hostname"), F.lit("x").alias("source"),
        F.concat(F.lit("env:"), F.col("source"), F.lit(", lang:"), F.col("lang"), F.lit(",flag")).alias("tags"), ((F.col("doc_id") + 1704067200) * 1000).alias("timestamp"),
    )
    out = nz.agent_logs(rows, "t0", 0)
    return out.select("ts_ns", "service_name", "severity_text", F.col("resource_attributes")["deployment.environment"].alias("environment"), F.col("log_attributes")["lang"].alias("label"))


@query("normalize_agent_spans", "SELECT lpad(lower(hex(o_orderkey)), 32, '0') AS trace_id, lpad(lower(hex(l_linenumber)), 16, '0') AS span_id, CASE WHEN l_linenumber = 1 THEN '' ELSE lpad(lower(hex(l_linenumber - 1)), 16, '0') END AS parent_span_id, CASE o_orderstatus WHEN 'F' THEN 'SPAN_KIND_SERVER' WHEN 'O' THEN 'SPAN_KIND_CLIENT' ELSE 'SPAN_KIND_INTERNAL' END AS span_kind, CASE WHEN l_returnflag = 'R' THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_OK' END AS status_code FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def normalize_agent_spans(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("o_orderkey") == F.col("l_orderkey"))
    empty = F.create_map().cast("map<string,string>")
    shaped = rows.select(
        F.col("o_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), (F.col("l_linenumber") - 1).alias("parent_id"), F.lit("op").alias("name"), F.lit("svc").alias("service"), F.lit("GET /").alias("resource"), F.when(F.col("o_orderstatus") == "F", "web").when(F.col("o_orderstatus") == "O", "sql").otherwise("x").alias("type"),
        F.lit(0).cast("bigint").alias("start"), F.lit(5).cast("bigint").alias("duration"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("error"), empty.alias("meta"), F.create_map().cast("map<string,double>").alias("metrics"), F.lit("h").alias("hostname"), F.lit("prod").alias("env"),
    )
    return nz.agent_spans(shaped, "t0").select("trace_id", "span_id", "parent_span_id", "span_kind", "status_code")


@query("normalize_remote_write", f"WITH {SAMPLES_SQL} SELECT metric_name, service_name, shard, ts_ms * 1000000 AS ts_ns, value, 'about ' || metric_name AS metric_description FROM samples")
def normalize_remote_write(spark, sf_dir):
    s = bind.samples(spark, sf_dir)
    labels = F.create_map(F.lit("__name__"), F.col("metric_name"), F.lit("job"), F.col("service_name"), F.lit("shard"), F.col("attributes")["shard"])
    series = s.groupBy("series_key").agg(F.first(labels).alias("labels"), F.collect_list(F.struct(F.col("ts_ms").alias("timestamp"), "value")).alias("samples"))
    about = s.select("metric_name", F.concat(F.lit("about "), "metric_name").alias("help"), F.lit("ms").alias("unit")).distinct()
    out = nz.remote_write(series, "t0", about)
    return out.select("metric_name", "service_name", F.col("attributes")["shard"].alias("shard"), "ts_ns", "value", "metric_description")


@query("firewall_apply", f"WITH {SAMPLES_SQL} SELECT service_name, CASE WHEN service_name = 'click' THEN NULL ELSE shard END AS shard, count(*) AS total FROM samples WHERE service_name = 'view' OR NOT regexp_matches(shard, '[34]') GROUP BY 1, 2")
def firewall_apply(spark, sf_dir):
    s = bind.samples(spark, sf_dir)
    s = s.withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("svc"), F.col("service_name"))))
    out = nz.firewall(s, [
        {"action": "block", "metric": "^app", "metric_regex": True, "label_key": "shard", "label_value": "[34]", "label_regex": True}, {"action": "allow", "label_key": "svc", "label_value": "view"}, {"action": "allow"},
        {"action": "drop_label", "label_key": "svc", "label_value": "click", "drop": "sh.*", "drop_regex": True}, {"action": "drop_label", "drop": ""}, {"action": "block", "metric": "app.value", "enabled": False},
    ])
    return out.groupBy("service_name", F.col("attributes")["shard"].alias("shard")).agg(F.count("*").alias("total"))


@query(
    "firewall_many",
    """WITH e AS (SELECT event_id, event_type, event_id % 7000 AS m, user_id % 5 AS shard FROM events)
    SELECT event_id, CASE WHEN m < 6000 AND m % 4 = 2 THEN NULL ELSE CAST(shard AS VARCHAR) END AS shard, CASE WHEN m % 10 = 7 AND shard = 3 OR m < 6000 AND m % 4 = 3 AND event_type = 'view' THEN NULL ELSE event_type END AS svc FROM e
    WHERE (m < 6000 AND m % 4 = 1 AND shard = 2) OR event_type = 'error' OR NOT (m < 6000 AND m % 4 = 0 AND shard IN (1, 3) OR m % 100 = 99)""",
)
def firewall_many(spark, sf_dir):
    """6,000 rules of all actions that name a metric, and some that do not."""
    e = bind.events(spark, sf_dir)
    rows = e.select("event_id", F.concat(F.lit("m"), (F.col("event_id") % 7000).cast("string")).alias("metric_name"), F.create_map(F.lit("shard"), (F.col("user_id") % 5).cast("string"), F.lit("svc"), F.col("event_type")).alias("attributes"))
    kinds = (
        {"action": "block", "label_key": "shard", "label_value": "[13]", "label_regex": True}, {"action": "allow", "label_key": "shard", "label_value": "2"},
        {"action": "drop_label", "drop": "sh", "drop_regex": True}, {"action": "drop_label", "drop": "svc", "label_key": "svc", "label_value": "view"},
    )
    rules = [kinds[i % 4] | {"metric": f"m{i}"} for i in range(6000)]
    rules += [
        {"action": "block", "metric": "99$", "metric_regex": True}, {"action": "allow", "label_key": "svc", "label_value": "error"}, {"action": "drop_label", "metric": "7$", "metric_regex": True, "label_key": "shard", "label_value": "3", "drop": "svc"},
        {"action": "block", "metric": "m[", "metric_regex": True}, {"action": "allow"}, {"action": "block", "enabled": False},
    ]
    out = nz.firewall(rows, rules)
    return out.select("event_id", F.col("attributes")["shard"].alias("shard"), F.col("attributes")["svc"].alias("svc"))


@query("derived_log_columns", f"""WITH {LOGS_SQL} SELECT span_id, 'ns-' || lang AS k8s_namespace, 'pod-' || span_id AS k8s_pod, '' AS k8s_container, 'dep' AS k8s_deployment, CASE WHEN lang = 'de' THEN 'old' ELSE 'new' END AS environment,
    CASE WHEN lang = 'de' THEN '10.0.0.1' ELSE '10.0.0.2' END AS source_ip, CASE WHEN lang = 'fr' THEN 'u-fr' ELSE 'id-' || lang END AS user_name, 'go-' || lang AS action FROM logs""")
def derived_log_columns(spark, sf_dir):
    """All eight, from first and second names of their attributes."""
    rows, lang = bind.logs(spark, sf_dir), F.col("log_attributes")["lang"]
    pair = lambda test, a, b: F.when(test, a).otherwise(b)
    resource = F.create_map(F.lit("k8s.namespace.name"), F.concat(F.lit("ns-"), lang), F.lit("k8s.pod.name"), F.concat(F.lit("pod-"), "span_id"), F.lit("k8s.deployment.name"), F.lit("dep"), F.lit("deployment.environment"), pair(lang == "de", "old", ""), F.lit("deployment.environment.name"), F.lit("new"))
    own = F.create_map(F.lit("source.ip"), pair(lang == "de", "10.0.0.1", ""), F.lit("client.address"), F.lit("10.0.0.2"), F.lit("user.name"), pair(lang == "fr", "u-fr", ""), F.lit("user.id"), F.concat(F.lit("id-"), lang), F.lit("action"), F.concat(F.lit("go-"), lang))
    names = ("k8s_namespace", "k8s_pod", "k8s_container", "k8s_deployment", "environment", "source_ip", "user_name", "action")
    return nz.derived_log_columns(rows.withColumns({"resource_attributes": resource, "log_attributes": own})).select("span_id", *names)


# --------------------------------------------------------------------- retention


@query("retention_keep", f"WITH {SAMPLES_SQL} SELECT service_name, count(*) AS total FROM samples WHERE NOT (shard = '1' AND ts < TIMESTAMP '2024-01-20') AND NOT ts < TIMESTAMP '2024-01-05' GROUP BY 1")
def retention_keep(spark, sf_dir):
    as_of = F.lit("2024-01-30").cast("timestamp")
    gone = retention.expired_metrics([{"metric": "app.*", "labels": {"shard": "1"}, "days": 10}, {"metric": "^app", "regex": True, "days": 25}, {"metric": "none*", "days": 1}], as_of)
    return retention.keep(bind.samples(spark, sf_dir), gone).groupBy("service_name").agg(F.count("*").alias("total"))


@query("retention_spans", f"WITH {SPANS_SQL} SELECT service_name, count(*) FILTER (service_name = 'view' AND k = 7 AND ts < TIMESTAMP '2024-01-25') AS expired, count(*) FILTER (NOT (service_name = 'view' AND k = 7 AND ts < TIMESTAMP '2024-01-25')) AS kept FROM spans GROUP BY 1")
def retention_spans(spark, sf_dir):
    gone = retention.expired_spans([{"service": "vi*", "attributes": {"k": "7"}, "days": 5}], F.lit("2024-01-30").cast("timestamp"))
    return retention.dry_run(bind.spans(spark, sf_dir), gone, ["service_name"])


@query("retention_tenants", f"WITH {SPANS_SQL} SELECT tenant_id, count(*) AS total FROM spans WHERE datediff('day', CAST(ts AS DATE), DATE '2024-01-30') <= CASE tenant_id WHEN 't1' THEN 7 ELSE 20 END GROUP BY 1")
def retention_tenants(spark, sf_dir):
    own = spark.createDataFrame([("t1", "traces", 7), ("t2", "traces", 90), ("t0", "logs", 1)], "tenant_id string, signal string, days int")
    return retention.keep_by_tenant(bind.spans(spark, sf_dir), own, "traces", 20, F.lit("2024-01-30").cast("timestamp")).groupBy("tenant_id").agg(F.count("*").alias("total"))


# ----------------------------------------------------------------------- streams


@contextmanager
def _small_state(spark, rocksdb: bool = False):
    """State stores of a few partitions for a bounded run, on RocksDB for arbitrary state."""
    keys = {"spark.sql.shuffle.partitions": "4"} | ({"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} if rocksdb else {})
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _by_day(spark, df):
    """The rows as a folder of files, for a file stream."""
    path = jobs.scratch(spark, "days")
    df.repartitionByRange(3, "ts").write.parquet(path)
    return path


def _stream(spark, df):
    return jobs.read(spark, _by_day(spark, df), df.schema, 1)


_ROLL = "round(sum(value), 4) AS sum, count(*) AS cnt, round(min(value), 6) AS min, round(max(value), 6) AS max"


@query("stream_rollup", f"WITH {SAMPLES_SQL} SELECT series_key, ts_ms // 3600000 * 3600 AS bucket, {_ROLL} FROM samples GROUP BY 1, 2")
def stream_rollup(spark, sf_dir):
    """Partial rows of every micro-batch, merged at read: equal to the batch, whatever comes late."""
    path = jobs.scratch(spark, "rollup")
    rows = bind.samples(spark, sf_dir).select("series_key", "ts", "ts_ms", "value")
    jobs.rollup_partials(_stream(spark, rows), path, path + "-state", 3600).awaitTermination()
    merged = rollup.merge(spark.read.parquet(path))
    return merged.select("series_key", "bucket", F.round("sum", 4).alias("sum"), "cnt", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


@query("stream_usage", "SELECT 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, epoch_us(ts) // 3600000000 * 3600 AS bucket, count(*) AS events_count, CAST(sum(length(props)) AS BIGINT) AS bytes_count FROM events GROUP BY 1, 2")
def stream_usage(spark, sf_dir):
    rows = bind.events(spark, sf_dir).select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), "ts", "props")
    with _small_state(spark):
        hours = jobs.drain(jobs.usage(_stream(spark, rows), "traces", "props", "40 days"), spark, "usage", "update")
    latest = hours.groupBy("tenant_id", F.unix_seconds("bucket").alias("bucket")).agg(F.max("events_count").alias("events_count"), F.max("bytes_count").alias("bytes_count"))
    return latest


@query("stream_rollup_windows", f"WITH {SAMPLES_SQL} SELECT series_key, ts_ms // 86400000 * 86400 AS bucket, {_ROLL} FROM samples GROUP BY 1, 2")
def stream_rollup_windows(spark, sf_dir):
    """Windows with a watermark that no row is too late for; of the updates of a window the fullest counts."""
    rows = bind.samples(spark, sf_dir).select("series_key", "ts", "value")
    with _small_state(spark):
        windows = jobs.drain(jobs.rollup_windows(_stream(spark, rows), 86400, "40 days"), spark, "windows", "update")
    last = windows.groupBy("series_key", "bucket").agg(F.max_by(F.struct("sum", "cnt", "min", "max"), "cnt").alias("r"))
    return last.select("series_key", "bucket", F.round("r.sum", 4).alias("sum"), "r.cnt", F.round("r.min", 6).alias("min"), F.round("r.max", 6).alias("max"))


@query("stream_first_spans", f"WITH {SPANS_SQL} SELECT span_id, service_name FROM spans")
def stream_first_spans(spark, sf_dir):
    """Every span arrives twice and is kept once."""
    rows = bind.spans(spark, sf_dir).select("trace_id", "span_id", "service_name", "ts")
    with _small_state(spark):
        return jobs.drain(jobs.first_spans(_stream(spark, rows.unionByName(rows)), "40 days"), spark, "first").select("span_id", "service_name")


@query("stream_slo_hours", f"WITH {SPANS_SQL} SELECT service_name, epoch_us(ts) // 3600000000 * 3600 AS bucket, count(*) FILTER (is_error) AS bad, count(*) AS total FROM spans GROUP BY 1, 2")
def stream_slo_hours(spark, sf_dir):
    from tidewatch.functions.core import is_error

    rows = bind.spans(spark, sf_dir).select("service_name", "ts", "http_status_code", "status")
    with _small_state(spark):
        hours = jobs.drain(jobs.slo_hours(_stream(spark, rows), is_error(), "40 days"), spark, "slo", "update")
    return hours.groupBy("service_name", "bucket").agg(F.max("bad").alias("bad"), F.max("total").alias("total"))


@query("stream_track_queries", "SELECT 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, event_type AS signal_name, epoch_us(max(ts)) AS last_queried, count(*) AS query_count FROM events GROUP BY 1, 2")
def stream_track_queries(spark, sf_dir):
    rows = bind.events(spark, sf_dir).select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("event_type").alias("signal_name"), F.lit("metric").alias("signal_type"), F.lit("ui").alias("source"), "ts")
    path = jobs.scratch(spark, "queried")
    jobs.track_queries(_stream(spark, rows), path, path + "-state").awaitTermination()
    seen = spark.read.parquet(path)
    return seen.groupBy("tenant_id", "signal_name").agg(F.unix_micros(F.max("last_queried_at")).alias("last_queried"), F.sum("query_count").alias("query_count"))


@query("stream_detect", f"WITH {SPANS_SQL} SELECT service_name, CAST(count(*) AS BIGINT) AS failures FROM spans WHERE http_status_code >= 500 GROUP BY 1")
def stream_detect(spark, sf_dir):
    """A rule on every micro-batch; what the batches find adds up."""
    rows = bind.spans(spark, sf_dir).select("service_name", "http_status_code", "ts")
    path = jobs.scratch(spark, "found")
    jobs.detect_each_batch(_stream(spark, rows), lambda batch: batch.where("http_status_code >= 500").groupBy("service_name").agg(F.count("*").alias("n")), path, path + "-state").awaitTermination()
    return spark.read.parquet(path).groupBy("service_name").agg(F.sum("n").alias("failures"))


@query("stream_flatten", f"WITH {SPANS_SQL} SELECT span_id, kind, status FROM spans")
def stream_flatten(spark, sf_dir):
    """Each span is flattened by itself: files of any order will do, so every task writes its own and batches take many."""
    raw = nz.spans_raw(_json_spans(spark, sf_dir), "t0")
    source, path = jobs.scratch(spark, "raw"), jobs.scratch(spark, "wide")
    raw.write.parquet(source)
    jobs.transform_to(jobs.read(spark, source, raw.schema, 48), path, path + "-state", nz.wide_spans).awaitTermination()
    return spark.read.parquet(path).select("span_id", "kind", "status")


@query(
    "stream_monitor",
    """WITH RECURSIVE v AS (SELECT event_type AS grp, epoch_us(ts) // 86400000000 * 86400 AS "at", round(avg(value), 6) AS value, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 86400000000 * 86400) AS i FROM events GROUP BY 1, 2),
    s AS (SELECT grp, "at", value, i, 'ok' AS old_state, CASE WHEN value >= 60 THEN 'alert' WHEN value >= 52 THEN 'warn' ELSE 'ok' END AS new_state FROM v WHERE i = 1
      UNION ALL SELECT v.grp, v."at", v.value, v.i, s.new_state, CASE WHEN s.new_state = 'alert' AND v.value >= 50 THEN 'alert' WHEN s.new_state = 'alert' THEN 'ok' WHEN v.value >= 60 THEN 'alert' WHEN s.new_state = 'warn' THEN CASE WHEN v.value < 52 THEN 'ok' ELSE 'warn' END WHEN v.value >= 52 THEN 'warn' ELSE 'ok' END FROM s JOIN v ON v.grp = s.grp AND v.i = s.i + 1)
    SELECT 'mean' AS rule_id, grp, "at", value, old_state, new_state FROM s WHERE old_state <> new_state""",
)
def stream_monitor(spark, sf_dir):
    e = bind.events(spark, sf_dir)
    day = (F.floor(F.unix_seconds("ts") / 86400) * 86400).cast("bigint")
    daily = e.groupBy(F.col("event_type").alias("grp"), day.alias("at")).agg(F.round(F.avg("value"), 6).alias("value")).select(F.lit("mean").alias("rule_id"), "grp", "at", "value", F.timestamp_seconds("at").alias("ts"))
    with _small_state(spark, rocksdb=True):
        path = jobs.scratch(spark, "daily")
        daily.repartitionByRange(1, "ts").sortWithinPartitions("ts").write.parquet(path)
        values = jobs.read(spark, path, daily.schema).select("rule_id", "grp", "at", "value")
        return jobs.drain(jobs.monitor(values, jobs.ThresholdMonitor(60.0, 50.0, 52.0)), spark, "monitor")


@query("slo_rolling", f"WITH {SPANS_SQL}, h AS (SELECT service_name, epoch_us(ts) // 3600000000 * 3600 AS bucket, count(*) FILTER (is_error) AS bad, count(*) AS total FROM spans GROUP BY 1, 2) SELECT service_name, bucket, CAST(sum(bad) OVER w AS BIGINT) AS bad, CAST(sum(total) OVER w AS BIGINT) AS total FROM h WINDOW w AS (PARTITION BY service_name ORDER BY bucket RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)")
def slo_rolling(spark, sf_dir):
    from tidewatch.functions.core import bucket, is_error

    hours = bind.spans(spark, sf_dir).groupBy("service_name", bucket(3600).alias("bucket")).agg(F.count_if(is_error()).alias("bad"), F.count("*").alias("total"))
    return jobs.rolling(hours, 24)


_RAW = """WITH RECURSIVE e AS (SELECT event_type AS grp, ts, value FROM events WHERE event_type <> 'signup' OR ts < TIMESTAMP '2024-01-15'),
    v AS (SELECT grp, start + 86400 AS "at", avg(value) AS value, row_number() OVER (PARTITION BY grp ORDER BY start) AS i FROM (
      SELECT grp, value, epoch_us(ts) // 43200000000 * 43200 - unnest([0, 43200]) AS start FROM e) GROUP BY grp, start HAVING (start + 86400) * 1000 <= (SELECT (max(epoch_us(ts)) // 1000 - 1000) FROM e)),
    s AS (SELECT grp, "at", value, i, 'ok' AS old_state, CASE WHEN value >= 60 THEN 'alert' WHEN value >= 52 THEN 'warn' ELSE 'ok' END AS new_state FROM v WHERE i = 1
      UNION ALL SELECT v.grp, v."at", v.value, v.i, s.new_state, CASE WHEN s.new_state = 'alert' AND v.value >= 50 THEN 'alert' WHEN s.new_state = 'alert' THEN 'ok' WHEN v.value >= 60 THEN 'alert' WHEN s.new_state = 'warn' THEN CASE WHEN v.value < 52 THEN 'ok' ELSE 'warn' END WHEN v.value >= 52 THEN 'warn' ELSE 'ok' END FROM s JOIN v ON v.grp = s.grp AND v.i = s.i + 1)"""


@query(
    "stream_monitor_samples",
    f"""{_RAW} SELECT grp, "at", round(value, 6) AS value, old_state, new_state FROM s WHERE old_state <> new_state
    UNION ALL SELECT grp, "at" + 172800, NULL, new_state, 'no_data' FROM s WHERE grp = 'signup' AND i = (SELECT max(i) FROM s WHERE grp = 'signup')""",
)
def stream_monitor_samples(spark, sf_dir):
    """From raw samples to changes of state in one stream: sliding means, a monitor, and a group that falls silent."""
    rows = bind.events(spark, sf_dir).where("event_type <> 'signup' OR ts < '2024-01-15'").select(F.lit("mean").alias("rule_id"), F.col("event_type").alias("grp"), "ts", "value")
    path = jobs.scratch(spark, "samples")
    for low, high in (("2000-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2100-01-01")):  # files in order of time, each a batch
        rows.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(path)
    with _small_state(spark, rocksdb=True):
        means = jobs.sliding_means(jobs.read(spark, path, rows.schema, 1), "1 day", "12 hours", "1 second")
        found = jobs.drain(jobs.monitor(means, jobs.ThresholdMonitor(60.0, 50.0, 52.0, silence_s=172800)), spark, "silence")
    return found.select("grp", "at", F.round("value", 6).alias("value"), "old_state", "new_state")


@query("stream_anomalies", f"""{_EWMA_SQL.replace("ORDER BY ts_ms, value", "ORDER BY ts").replace("SELECT series_key, value AS x,", "SELECT series_key, ts, value AS x,")}
    SELECT series_key, epoch_us(ts) AS "at", x AS value, hit AS anomalous FROM s JOIN v USING (series_key, i) WHERE i > 12 AND ts >= TIMESTAMP '2024-01-15'""")
def stream_anomalies(spark, sf_dir):
    """A stream that goes on from the bands that a batch over the days before has left."""
    rows = bind.samples(spark, sf_dir).select("series_key", F.unix_micros("ts").alias("at"), "value", "ts")
    before = F.col("ts") < "2024-01-15"
    bands = rules.ewma_bands(rows.where(before), ["series_key"], "at")
    with _small_state(spark, rocksdb=True):
        path = jobs.scratch(spark, "later")
        rows.where(~before).repartitionByRange(1, "ts").write.parquet(path)
        later = jobs.read(spark, path, rows.schema).select("series_key", "at", "value")
        return jobs.drain(jobs.anomalies(later, jobs.EwmaMonitor(), bands), spark, "anomalies")


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS begins FROM events), s AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g)
    SELECT user_id, epoch_us(min(ts)) // 1000000 AS started, epoch_us(max(ts)) // 1000000 + 21600 AS ended, count(*) AS events FROM s GROUP BY user_id, i""",
)
def stream_sessions(spark, sf_dir):
    """Sessions of users by inactivity, complete after the last batch."""
    rows = bind.events(spark, sf_dir).select("user_id", "ts")
    with _small_state(spark):
        every = jobs.drain(jobs.session_windows(_stream(spark, rows), "user_id", "6 hours", "40 days"), spark, "sessions", "complete")
    last = every.agg(F.max("batch").alias("last"))
    return every.join(F.broadcast(last), F.col("batch") == F.col("last")).select("user_id", "started", "ended", "events")  # one row


@query("retention_effective", f"WITH {SAMPLES_SQL} SELECT service_name, count(*) AS total FROM samples WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAY AND (service_name <> 'click' OR ts >= TIMESTAMP '2024-01-29') GROUP BY 1")
def retention_effective(spark, sf_dir):
    """The longest of a default and the rules for a table, and a cap that is never under a day for one service."""
    as_of, rows = F.lit("2024-01-30").cast("timestamp"), bind.samples(spark, sf_dir)
    table = retention.effective_days(7, [20, 14])
    rules_ = [{"metric": "app*", "days": table}]
    kept = retention.keep(rows, retention.expired_metrics(rules_, as_of))
    own = retention.capped_days(0, 0)
    gone = retention.expired_metrics([{"metric": "app*", "days": own}], as_of) & (F.col("service_name") == "click")
    return retention.keep(kept, gone).groupBy("service_name").agg(F.count("*").alias("total"))


@query("anomaly_steps", f"WITH {SPANS_SQL} SELECT service_name, w, epoch_us(ts) // 1000000 // step * step AS bucket, count(*) AS total FROM spans JOIN (VALUES (3600, 15), (21600, 60), (86400, 300)) t(w, step) ON epoch_us(ts) // 1000000 >= 1705276800 - w AND epoch_us(ts) // 1000000 < 1705276800 GROUP BY 1, 2, 3")
def anomaly_steps(spark, sf_dir):
    """Series of the hour, six hours and day before a time, each in the steps of its window."""
    spans, at = bind.spans(spark, sf_dir), F.unix_seconds("ts")
    one = lambda w: rules.apm_series(spans.where((at >= 1705276800 - w) & (at < 1705276800)), rules.anomaly_step(w)).select("service_name", F.lit(w).alias("w"), "bucket", "total")
    return one(3600).unionByName(one(21600)).unionByName(one(86400))
