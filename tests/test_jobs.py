import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import normalize as nz
from tidewatch.operators import retention
from tidewatch.plans import jobs as plans


def read_json(spark, record, schema):
    return spark.createDataFrame([(json.dumps(record),)], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def kv(key, **value):
    return {"key": key, "value": value}


def test_traces_with_every_kind_of_value(spark):
    attrs = [kv("s", stringValue="x"), kv("i", intValue=3), kv("b", boolValue=True), kv("d", doubleValue=1.5), kv("a", arrayValue={"values": [{"intValue": 1}, {"stringValue": "z"}]}), kv("m", kvlistValue={"values": [kv("q", intValue=2)]}), kv("s", stringValue="last"), kv("http.response.status_code", stringValue="503")]
    span = {"traceId": "AB", "spanId": "CD", "name": "op", "kind": 2, "startTimeUnixNano": 2000, "endTimeUnixNano": 1000, "attributes": attrs, "status": {"code": 2, "message": "bad"}, "events": [{"timeUnixNano": 5, "name": "e", "attributes": [kv("k", stringValue="v")]}]}
    record = {"resourceSpans": [{"resource": {"attributes": [kv("service.name", stringValue="svc")]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span, {"traceId": "EF", "spanId": "01", "name": "bare", "startTimeUnixNano": 1, "endTimeUnixNano": 4}]}]}]}
    raw = nz.spans_raw(read_json(spark, record, nz.SPAN_RECORDS), "t")
    one, bare = raw.orderBy("trace_id").collect()
    assert one.span_attributes == {"s": "last", "i": "3", "b": "true", "d": "1.5", "a": "[1,z]", "m": "{q=2}", "http.response.status_code": "503"}
    assert (one.duration_ns, one.span_kind, one.status_code, one.service_name) == (0, "SPAN_KIND_SERVER", "STATUS_CODE_ERROR", "svc")
    assert (bare.duration_ns, bare.span_kind, bare.status_code, bare.parent_span_id) == (3, "SPAN_KIND_UNSPECIFIED", "STATUS_CODE_UNSET", "")
    wide = nz.wide_spans(raw).orderBy("trace_id").first()
    assert (wide.http_path, wide.http_status_code, wide.event_names) == ("op", 503, ["e"])


def test_logs_and_metrics(spark):
    log = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"observedTimeUnixNano": 7000, "severityNumber": 17, "body": {"stringValue": "hi"}}, {"body": {"intValue": 4}}]}]}]}
    rows = nz.logs(read_json(spark, log, nz.LOG_RECORDS), "t", 9000).orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.body, r.severity_number) for r in rows] == [(7000, "hi", 17), (9000, "4", 0)]
    point = {"timeUnixNano": 1, "asInt": 5, "attributes": [kv("k", stringValue="v")]}
    metric = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "g", "gauge": {"dataPoints": [point]}}, {"name": "c", "sum": {"dataPoints": [point], "isMonotonic": True, "aggregationTemporality": 2}}, {"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": 1, "count": 3, "bucketCounts": [1, 2], "explicitBounds": [5.0]}]}}]}]}]}
    tables = {k: v.collect() for k, v in nz.metrics(read_json(spark, metric, nz.METRIC_RECORDS), "t").items()}
    assert {k: [r.metric_name for r in v] for k, v in tables.items()} == {"metrics_gauge": ["g"], "metrics_sum": ["c"], "metrics_histogram": ["h"], "metrics_exp_histogram": [], "metrics_summary": []}
    assert tables["metrics_gauge"][0].value == 5.0 and tables["metrics_gauge"][0].attributes == {"k": "v"} and tables["metrics_sum"][0].is_monotonic


def test_agent_and_shipper_rows(spark):
    lines = spark.createDataFrame([('[{"message":"a","level":"warn","x":"1"},{"message":"b"}]',), ('{"message":"c","timestamp":"2024-01-01T00:00:00Z"}',), ("broken",)], "value string")
    got = {r.body: (r.severity_text, r.log_attributes, r.ts_ns) for r in nz.shipper_logs(lines, "t", 5).collect()}
    assert got["a"] == ("WARN", {"x": "1"}, 5) and got["c"][2] == 1704067200 * 10**9
    tagged = spark.sql("SELECT 'env:prod, k:a:b,flag,,k:last' AS t").select(nz.tags(F.col("t"))).first()[0]
    assert tagged == {"env": "prod", "k": "last", "flag": ""}
    at = spark.createDataFrame([(900_000_000,), (1_700_000_000_000,), (1_700_000_000_000_000_000,), (1_700_000_000,), (None,)], "t bigint").select(nz.epoch_ns(F.col("t"), 1)).collect()
    assert [r[0] for r in at] == [900_000_000 * 10**9, 1_700_000_000 * 10**9, 1_700_000_000 * 10**9, 1_700_000_000 * 10**6, 1]
    checks = spark.sql("SELECT 'up' AS check, 1 AS status, 'h1' AS host, array('a:b') AS tags, 10 AS timestamp")
    assert nz.service_checks(checks, "t").first().metric_name == "dd.check.up"
    series = spark.sql("SELECT 'm' AS metric, 'count' AS type, 'h' AS host, array('service:s', 'k:v') AS tags, array(named_struct('timestamp', 1L, 'value', 2.0D)) AS points")
    row = nz.agent_metrics(series, "t").first()
    assert (row.kind, row.service_name, row.attributes) == ("sum", "s", {"k": "v", "host.name": "h"})


def test_firewall_rules(spark):
    rows = spark.createDataFrame([("node_cpu", {"a": "1"}), ("node_mem", {"a": "2"}), ("app", {"a": "1", "pod": "p"}), ("app2", None)], "metric_name string, attributes map<string,string>")
    names = lambda rules: sorted(r.metric_name for r in nz.firewall(rows, rules).collect())
    assert names([{"action": "block", "metric": "app"}, {"action": "block", "metric": "^node_.*", "metric_regex": True}]) == ["app2"]
    assert names([{"action": "block", "metric": "^node", "metric_regex": True}, {"action": "allow", "label_key": "a", "label_value": "1"}]) == ["app", "app2", "node_cpu"]
    assert names([{"action": "block", "metric": "app"}, {"action": "allow"}]) == ["app2", "node_cpu", "node_mem"]
    dropped = {r.metric_name: r.attributes for r in nz.firewall(rows, [{"action": "drop_label", "drop": "pod"}, {"action": "drop_label", "drop": ""}]).collect()}
    assert dropped["app"] == {"a": "1"} and dropped["app2"] is None


def test_retention_rewrites_only_what_expires(spark, tmp_path):
    rows = spark.sql("SELECT 'm' AS metric_name, map('k', 'v') AS attributes, ts, to_date(ts) AS date FROM VALUES (TIMESTAMP '2024-01-01 00:00:00'), (TIMESTAMP '2024-01-05 00:00:00'), (TIMESTAMP '2024-01-05 12:00:00') AS t(ts)")
    path = str(tmp_path / "m")
    rows.write.partitionBy("date").parquet(path)
    gone = retention.expired_metrics([{"metric": "m*", "labels": {"k": "v"}, "days": 1}], F.lit("2024-01-06 06:00:00").cast("timestamp"))
    assert [str(d) for d in retention.rewrite(spark, path, gone)] == ["2024-01-01", "2024-01-05"]
    assert [str(r.ts) for r in spark.read.parquet(path).collect()] == ["2024-01-05 12:00:00"]
    assert retention.rewrite(spark, path, gone) == []
    assert retention.effective_days(30, [7, 90]) == 90 and retention.capped_days(0, 14) == 14 and retention.capped_days(-3, 14) == 1


def test_scans_prune_dates_and_push_filters(spark, sf_dir, tmp_path):
    from tidewatch.sources import tables

    root = str(tmp_path)
    tables.append(plans.bind.spans(spark, sf_dir), root, "spans")
    found = tables.scan(spark, root, "spans", "t1", "2024-01-10", "2024-01-12").select("span_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: [")[1].split("]")[0] and "2024-01-10" in plan
    assert "EqualTo(tenant_id,t1)" in plan and "attributes" not in plan.split("ReadSchema")[1]
    assert found.count() > 0


def test_estimated_percentiles_are_close(spark, sf_dir):
    from tidewatch.functions import core
    from tidewatch.operators import rules, rum, services

    many = spark.range(100_000).select((F.pow(F.col("id") % 9973, F.lit(2)) / 1000).alias("v"))
    for point in (0.5, 0.75, 0.95, 0.99):
        exact, near = many.select(core.percentile(F.col("v"), point), core.percentile(F.col("v"), point, True)).first()
        assert abs(exact - near) <= 0.002 * exact
    spans = plans.bind.spans(spark, sf_dir)
    for make in (lambda a: rules.apm_series(spans, 3600, a), lambda a: rules.apm_values(spans, "p95", 60, approx=a), lambda a: rum.vitals(plans.bind.rum(spark, sf_dir), a), lambda a: services.endpoint_red(spans, "view", a), lambda a: services.operation_red(spans, "view", approx=a)):
        assert make(True).columns == make(False).columns and make(True).count() == make(False).count() > 0


def test_streams_equal_batches(spark, sf_dir):
    merged = {(r.series_key, r.bucket): r.cnt for r in plans.stream_rollup(spark, sf_dir).collect()}
    batch = {(r.series_key, r.bucket): r.n for r in plans.bind.samples(spark, sf_dir).groupBy("series_key", (F.floor(F.col("ts_ms") / 3_600_000) * 3600).alias("bucket")).agg(F.count("*").alias("n")).collect()}
    assert merged == batch


def _series(n, length, seed):
    """Random series with jumps, flat parts and a few values at most of some."""
    import random

    draw = random.Random(seed)
    return {f"s{i}": [round(max(0.0, draw.gauss(50, draw.choice((0.0, 1.0, 20.0))) * draw.choice((1, 1, 1, 1, 3))), 3) for _ in range(draw.choice((5, 12, 13, length)))] for i in range(n)}


def test_bands_of_streams_equal_those_of_batches(spark, tmp_path):
    """From nothing, and from the bands that a batch has left at any point."""
    from tests.test_rules import ewma
    from tidewatch.operators import rules
    from tidewatch.streaming import jobs

    series = _series(60, 40, 11)
    rows = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "series_key string, at bigint, value double")
    want = {(k, i): ewma(vs[: i + 1])[1] for k, vs in series.items() for i in range(12, len(vs))}
    for cut in (0, 7, 20):
        later = rows.where(F.col("at") >= cut)
        later.coalesce(1).write.parquet(str(tmp_path / f"in{cut}"))
        bands = rules.ewma_bands(rows.where(F.col("at") < cut), ["series_key"], "at") if cut else None
        with plans._small_state(spark, rocksdb=True):
            got = jobs.drain(jobs.anomalies(jobs.read(spark, str(tmp_path / f"in{cut}"), rows.schema), jobs.EwmaMonitor(), bands), spark, "anomalies").collect()
        assert {(r.series_key, r["at"]): r.anomalous for r in got} == {k: v for k, v in want.items() if k[1] >= cut}


def test_a_monitor_begins_with_what_a_batch_has_left(spark, tmp_path):
    from tidewatch.streaming import jobs

    rows = spark.createDataFrame([("r", "a", 1, 57.0), ("r", "b", 1, 57.0)], "rule_id string, grp string, at bigint, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.createDataFrame([("r", "a", "alert")], "rule_id string, grp string, state string")
    with plans._small_state(spark, rocksdb=True):
        got = jobs.drain(jobs.monitor(jobs.read(spark, str(tmp_path / "in"), rows.schema), jobs.ThresholdMonitor(60.0, 58.0, 52.0), before), spark, "begun").collect()
    assert {(r.grp, r.old_state, r.new_state) for r in got} == {("a", "alert", "warn"), ("b", "ok", "warn")}


def test_a_batch_that_runs_again_is_found_once(spark, tmp_path):
    """The second run of a batch overwrites what the first has left: its checkpoint is set back as after a crash."""
    import shutil

    from tidewatch.streaming import jobs

    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, g int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: jobs.detect_each_batch(jobs.read(spark, str(tmp_path / "in"), rows.schema), lambda b: b.groupBy("g").count(), out, state).awaitTermination()
    run()
    shutil.rmtree(f"{state}/commits")
    run()
    assert sorted((r.g, r["count"], r.batch) for r in spark.read.parquet(out).collect()) == [(g, 10, 0) for g in range(3)]


def test_late_rows_follow_the_policy_of_each_stream(spark, tmp_path):
    """Windows drop rows behind the watermark, partial rows keep them; sessions end after a gap."""
    import time

    from tidewatch.operators import rollup
    from tidewatch.streaming import jobs

    schema = "series_key string, ts timestamp, ts_ms bigint, value double"
    for at in ([10, 3600], [3700], [20], [18_000]):  # the third file is late; a watermark filters from the second batch after it on
        rows = [("s", t * 1000, float(t)) for t in at]
        df = spark.createDataFrame(rows, "series_key string, ts_ms bigint, value double").withColumn("ts", F.timestamp_millis("ts_ms")).select("series_key", "ts", "ts_ms", "value")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in order of their times
    stream = lambda: jobs.read(spark, str(tmp_path / "in"), schema, 1)
    with plans._small_state(spark):
        closed = {r.bucket: (r.cnt, r["sum"]) for r in jobs.drain(jobs.rollup_windows(stream(), 60, "10 minutes"), spark, "closed").collect()}
        sessions = {(r.started, r.ended, r.events) for r in jobs.drain(jobs.session_windows(stream(), "series_key", "30 minutes", "10 minutes"), spark, "sessions").collect()}
    assert closed == {0: (1, 10.0), 3600: (1, 3600.0), 3660: (1, 3700.0)}
    assert sessions == {(10, 1810, 1), (3600, 5500, 2)}
    path = str(tmp_path / "partials")
    jobs.rollup_partials(stream(), path, path + "-state", 60).awaitTermination()
    assert {r.bucket: (r.cnt, r["sum"]) for r in rollup.merge(spark.read.parquet(path)).collect()} == {0: (2, 30.0), 3600: (1, 3600.0), 3660: (1, 3700.0), 18_000: (1, 18_000.0)}


def test_flattening_a_stream_orders_no_files(spark, sf_dir, monkeypatch):
    """Ranges of times would normalise all spans twice, once for a sample, and leave three tasks to write them."""
    monkeypatch.setattr(plans, "_by_day", lambda *_: pytest.fail("spans are put in order"))
    rows = plans.stream_flatten(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert rows.count() == rows.select("span_id").distinct().count() == events.count()
    assert rows.where("status = 'STATUS_CODE_ERROR'").count() == events.where("event_type = 'error'").count()
