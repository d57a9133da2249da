import pytest
from pyspark.sql import functions as F

from tidewatch.operators import expressions as e
from tidewatch.operators import series as ts
from tidewatch.sources import bind

HOUR, DAY = 3_600_000, 86_400_000
GRID = ts.Grid(1704844800000, 1704844800000 + 12 * HOUR, HOUR)


def test_an_expression_knows_how_far_back_it_reads():
    assert e.lookback(e.Metric("m")) == 300_000 == ts.lookback()
    ratio = e.Metric("m", (), HOUR).over("rate") / e.Aggregate("sum", e.Metric("n", (), 6 * HOUR, DAY).over("rate"))
    assert e.lookback(ratio) == 6 * HOUR + DAY and {m.name for m in ratio.metrics()} == {"m", "n"}
    assert e.lookback(e.Apply("abs", e.Metric("m", (), 60_000).over("increase"))) == 60_000
    with pytest.raises(ValueError):
        e.Metric("m").over("rate")


def test_a_composed_expression_equals_one_built_by_hand(spark, sf_dir):
    rows = bind.samples(spark, sf_dir).cache()
    node = e.Aggregate("sum", e.Metric("app.value", (("shard", "1"),), 6 * HOUR).over("avg_over_time"), by=("service_name",)) - e.Aggregate("max", e.Metric("app.value", offset_ms=DAY), by=("service_name",))
    shifted = rows.withColumn("ts_ms", F.col("ts_ms") + DAY)
    left = ts.aggregate(ts.range_function(rows.where(F.col("labels")["shard"] == "1"), GRID, 6 * HOUR, "avg_over_time"), "sum", by=["service_name"])
    want = ts.binary(left, ts.aggregate(ts.instant_select(shifted, GRID), "max", by=["service_name"]), "-")
    show = lambda df: sorted((r.series_key, r.k, round(r.value, 9)) for r in df.collect())
    assert show(e.evaluate(node, rows, GRID)) == show(want) != []


def test_the_scan_is_bounded_and_shared_parts_are_computed_once(spark, sf_dir, tmp_path):
    bind.samples(spark, sf_dir).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    part = e.Aggregate("sum", e.Metric("app.value", (), HOUR).over("sum_over_time"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    text = e.evaluate(part, stored, GRID)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text.split("PushedFilters: [")[1].split("]")[0]
    assert "metric_name" in pushed and "GreaterThanOrEqual(ts," in pushed and "LessThanOrEqual(ts," in pushed
    columns = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "event_id" not in columns and "user_id" not in columns
    seen = []
    original = ts.range_function
    try:
        ts.range_function = lambda *a, **k: seen.append(a[3]) or original(*a, **k)
        e.evaluate(part / part + part, stored, GRID)
    finally:
        ts.range_function = original
    assert seen == ["sum_over_time"]
