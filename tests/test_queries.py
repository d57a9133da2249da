"""Registered queries against their SQL twins in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewatch.plans import registry

SAMPLE = (
    "red_timeseries service_edges compare_windows trace_summary span_tree funnel rum_sessions text_search error_templates rate increase deriv agg_sum agg_topk bin_div "
    "vec_unless histogram_quantile rollup_merge monitor_states slo_trace_availability ewma_anomaly detect_post_deploy_errors usage_tenants scan_spans scan_metrics_gauge normalize_gauges any_values normalize_agent_metrics span_search autocomplete_endpoint bin_group_right bin_gt_mean maintenance_suppressed normalize_traces firewall_apply retention_tenants correlated_services correlated_logs rollup_described auto_query_gauge auto_query_counter "
    "monitors_many detect_many objectives_many estimated_percentiles window_quantiles rollup_quantiles rollup_uniques sketch_funnel fresh_series firewall_many trace_fetch trace_projection "
    "derived_log_columns stream_monitor_samples stream_anomalies stream_sessions histogram_quantile_last export_csv export_json retention_effective anomaly_steps"
).split()


#: Digits compared.
DIGITS = 4


def cells(row):
    return tuple(None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), DIGITS) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(map(repr, (cells(r) for r in df.select(*columns).collect())))
    assert got == sorted(map(repr, (cells(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())))


def test_every_query_but_a_few_has_a_twin():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert not set(registry.QUERIES) - set(registry.ORACLES)


@pytest.mark.parametrize("name", ["count_buckets", "usage_merge", "histogram_quantile", "histogram_quantile_last", "red_timeseries", "rollup_1m", "rollup_merge"])
def test_times_between_milliseconds_match_sql(spark, tmp_path, name):
    """Half a millisecond before an hour and a step, and two samples of a millisecond that ends its minute."""
    times = ["2024-01-06 05:59:59.999400", "2024-01-06 05:59:59.999500", "2024-01-06 05:59:59.999900", "2024-01-06 06:00:00.000100", "2024-01-06 23:59:59.999700"]
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS event_id, TIMESTAMP '{t}' AS ts, 5::BIGINT AS user_id, 'view' AS event_type, {v}::DOUBLE AS value, '{{\"k\": {i}}}' AS props" for i, (t, v) in enumerate(zip(times, (3, 4, 90, 30, 150)))))
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df, want = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(map(repr, (cells(r) for r in df.select(*columns).collect()))) == sorted(map(repr, (cells(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())))
