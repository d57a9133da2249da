"""Schemas of the telemetry tables, as DDL. Nanosecond times are BIGINT; ``ts`` is derived."""

from __future__ import annotations

SPANS_RAW = (
    "tenant_id string, ts_ns bigint, ts timestamp, trace_id string, span_id string, parent_span_id string, trace_state string,"
    "span_name string, span_kind string, service_name string, resource_attributes map<string,string>, scope_name string,"
    "scope_version string, scope_attributes map<string,string>, span_attributes map<string,string>, duration_ns bigint,"
    "status_code string, status_message string,"
    "events array<struct<ts_ns:bigint,name:string,attributes:map<string,string>>>,"
    "links array<struct<trace_id:string,span_id:string,trace_state:string,attributes:map<string,string>>>"
)
SPANS = (
    "tenant_id string, ts_ns bigint, ts timestamp, trace_id string, span_id string, parent_span_id string, service_name string,"
    "span_name string, kind string, status string, duration_ns bigint, http_method string, http_path string, http_status_code int,"
    "attributes map<string,string>, event_names array<string>, event_timestamps array<bigint>, event_attributes array<string>,"
    "link_trace_ids array<string>, link_span_ids array<string>"
)
LOGS = (
    "tenant_id string, ts_ns bigint, ts timestamp, trace_id string, span_id string, trace_flags int, severity_text string,"
    "severity_number int, body string, service_name string, resource_attributes map<string,string>, scope_name string,"
    "scope_version string, scope_attributes map<string,string>, log_attributes map<string,string>, event_name string"
)
_METRIC = (
    "tenant_id string, resource_attributes map<string,string>, scope_name string, scope_version string, service_name string,"
    "metric_name string, metric_description string, metric_unit string, attributes map<string,string>, start_ns bigint, ts_ns bigint"
)
_EXEMPLARS = "exemplars array<struct<attributes:map<string,string>,ts_ns:bigint,value:double,span_id:string,trace_id:string>>"
GAUGE = (f"{_METRIC}, value double, flags int, {_EXEMPLARS}")
SUM = (f"{_METRIC}, value double, flags int, {_EXEMPLARS}, aggregation_temporality int, is_monotonic boolean")
HISTOGRAM = (
    f"{_METRIC}, count bigint, sum double, min double, max double, bucket_counts array<bigint>, explicit_bounds array<double>, flags int, {_EXEMPLARS}, aggregation_temporality int"
)
EXP_HISTOGRAM = (
    f"{_METRIC}, count bigint, sum double, scale int, zero_count bigint, positive_offset int, positive_bucket_counts array<bigint>,"
    f"negative_offset int, negative_bucket_counts array<bigint>, min double, max double, flags int, {_EXEMPLARS}, aggregation_temporality int"
)
SUMMARY = (f"{_METRIC}, count bigint, sum double, quantiles array<struct<quantile:double,value:double>>, flags int")
RUM = (
    "tenant_id string, ts_ns bigint, ts timestamp, app_name string, app_version string, environment string, session_id string, user_id string,"
    "page_url string, page_path string, view_name string, referrer string, browser_name string, browser_version string, os_name string,"
    "os_version string, device_type string, screen_width int, screen_height int, event_type string, event_name string, vital_name string,"
    "vital_value double, vital_rating string, error_message string, error_stack string, error_type string, interaction_target string,"
    "interaction_type string, duration_ms double, trace_id string, span_id string, attributes map<string,string>"
)
RUM_REPLAY = ("tenant_id string, session_id string, app_name string, chunk_idx int, chunk_ts timestamp, events_json string")
SIGNAL_USAGE = ("tenant_id string, signal_name string, signal_type string, source string, last_queried_at timestamp, query_count bigint")
TENANT_USAGE = ("tenant_id string, signal string, bucket timestamp, events_count bigint, bytes_count bigint")

TABLES = {
    "spans_raw": SPANS_RAW, "spans": SPANS, "logs": LOGS, "metrics_gauge": GAUGE, "metrics_sum": SUM, "metrics_histogram": HISTOGRAM,
    "metrics_exp_histogram": EXP_HISTOGRAM, "metrics_summary": SUMMARY, "rum": RUM, "rum_replay": RUM_REPLAY,
    "signal_usage": SIGNAL_USAGE, "tenant_usage": TENANT_USAGE,
}
#: Columns of a span list.
SLIM = ["ts_ns", "trace_id", "span_id", "service_name", "span_name", "kind", "status", "duration_ns", "http_method", "http_status_code"]
