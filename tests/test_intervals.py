import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import intervals, rules, services
from tidewatch.sources import bind, tables

def frames(spark, points, windows):
    p = spark.createDataFrame(points, "id int, k string, at double").selectExpr("id", "k", "timestamp_micros(CAST(at * 1000000 AS BIGINT)) AS ts")
    w = spark.createDataFrame(windows, "w int, k string, a double, b double").selectExpr("w", "k AS scope", "timestamp_micros(CAST(a * 1000000 AS BIGINT)) AS starts", "timestamp_micros(CAST(b * 1000000 AS BIGINT)) AS ends")
    return p, w


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_comparing_all_with_all(spark, seed):
    draw = random.Random(seed)
    points = [(i, draw.choice("ab"), draw.choice((draw.uniform(-1e4, 1e5), float(draw.randrange(0, 1000, 10))))) for i in range(300)] + [(900, "a", None)]
    windows = []
    for w in range(60):
        start = draw.uniform(-1e4, 1e5)
        windows.append((w, draw.choice("ab"), start, start + draw.choice((0.0, 0.5, 10.0, 500.0, 90_000.0))))
    windows += [(61, "a", 100.0, 50.0), (62, "a", None, 50.0), (63, "b", 10.0, 10.0), (64, "b", 0.0, 100.0)]
    p, w = frames(spark, points, windows)
    hits = {(i, j) for i, _, at in points for j, _, a, b in windows if at is not None and a is not None and round(a * 1e6) <= round(at * 1e6) <= round(b * 1e6)}
    assert {(r.id, r.w) for r in intervals.interval_join(p, w.drop("scope")).collect()} == hits
    scope = {j: k for j, k, *_ in windows}
    keyed = {(i, j) for i, j in hits if dict((q[0], q[1]) for q in points)[i] == scope[j]}
    assert {(r.id, r.w) for r in intervals.interval_join(p, w, keys={"k": "scope"}).collect()} == keyed
    free = {q[0] for q in points} - {i for i, _ in keyed}
    assert sorted(r.id for r in intervals.outside(p, w, keys={"k": "scope"}).collect()) == sorted(free)
    assert intervals.outside(p, w.limit(0)).count() == len(points) and intervals.interval_join(p, w.limit(0)).count() == 0


def test_many_windows_meet_many_events_by_hash(spark):
    windows = spark.range(100_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'all' ELSE concat('r', id % 50) END AS scope", "timestamp_seconds(id * 600) AS starts", "timestamp_seconds(id * 600 + 60 * (id % 5)) AS ends").cache()
    events = spark.range(20_000).selectExpr("concat('r', id % 60) AS rule_id", "timestamp_seconds(id * 2999 + 30) AS ts")
    left = rules.suppressed(events, windows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        count = left.count()
        text = left._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in text and "Cartesian" not in text
    def free(i):
        at = i * 2999 + 30
        j = at // 600
        inside = at <= j * 600 + 60 * (j % 5)
        return not (inside and (j % 2 == 0 or j % 50 == i % 60))
    assert count == sum(free(i) for i in range(20_000))


def leaf_rows(df):
    """Rows that the scan of a plan without shuffles has given."""
    df._jdf.queryExecution().executedPlan()
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_a_trace_is_looked_up_in_few_row_groups(spark, sf_dir, tmp_path):
    spans = bind.spans(spark, sf_dir).drop("event_attributes")
    tables.store_by_trace(spans, str(tmp_path / "t"), files=8)
    stored = spark.read.parquet(str(tmp_path / "t"))
    total, trace = stored.count(), stored.orderBy("trace_id").first().trace_id
    found = stored.where(F.col("trace_id") == trace).select("trace_id", "span_id")
    assert 0 < found.count() <= leaf_rows(stored.where(F.col("trace_id") == trace).select("trace_id", "span_id")) < total / 4
    span = stored.orderBy(F.desc("ts_ns")).first().span_id
    assert leaf_rows(stored.where(F.col("span_id") == span).select("span_id")) < total / 4  # by the filter: span ids are in no order


def test_traces_are_fetched_from_their_dates_only(spark, sf_dir, tmp_path):
    tables.append(bind.spans(spark, sf_dir), str(tmp_path), "spans")
    rows = spark.read.parquet(f"{tmp_path}/spans")
    wanted = rows.where("date = '2024-01-12'").select("trace_id").distinct()
    index = services.trace_index(rows).cache()
    got = services.trace_spans(rows, wanted, index)
    text = got._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"PartitionFilters: \[([^\]]*)\]", text)
    days = {r.date for r in rows.select("date").distinct().collect()}
    assert len(days) == 30 and any("19734" in f or "2024-01-12" in f for f in read), read  # the day itself, by name or number
    assert {r.date.isoformat() for r in got.select("date").distinct().collect()} <= {"2024-01-11", "2024-01-12", "2024-01-13"}
    want = {r.span_id for r in rows.join(wanted, "trace_id", "left_semi").collect()}
    assert {r.span_id for r in got.collect()} == want


def test_edges_of_a_bucketed_table_need_no_shuffle(spark, sf_dir, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS buckets LOCATION 'file://{tmp_path}/db'")
    tables.save_bucketed(bind.spans(spark, sf_dir).drop("event_attributes"), "buckets.spans", 4)
    want = sorted(map(tuple, services.service_edges(bind.spans(spark, sf_dir)).select("parent", "child", "calls").collect()))
    old = {k: spark.conf.get(k) for k in (*tables.BY_BUCKET, "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in {**tables.BY_BUCKET, "spark.sql.autoBroadcastJoinThreshold": "-1"}.items():
            spark.conf.set(k, v)
        edges = services.service_edges(spark.table("buckets.spans"))
        plan = edges._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, edges.select("parent", "child", "calls").collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sql("DROP DATABASE buckets CASCADE")
    assert got == want and plan.count("Exchange hashpartitioning(trace_id") == 0 and plan.count("Exchange hashpartitioning(parent") == 1
