import random

from pyspark.sql import functions as F

from tidewatch.operators import sketches


def frame(spark, n=20_000, seed=3):
    draw = random.Random(seed)
    rows = [(draw.choice("ab"), i * 37 % 86_400, draw.lognormvariate(3, 1), draw.randrange(n // 4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at int, v double, u int").withColumn("ts", F.timestamp_seconds("at"))


def near(value, ordered, rank, error):
    low, high = int(len(ordered) * (rank - error)) - 1, int(len(ordered) * (rank + error)) + 1
    return ordered[max(low, 0)] <= value <= ordered[min(high, len(ordered) - 1)]


def test_percentiles_of_a_day_from_sketches_of_minutes(spark, tmp_path):
    rows, df = frame(spark)
    sketches.quantile_partials(df.where("at < 40000"), ["k"], F.col("v"), 60).write.parquet(str(tmp_path / "t"))
    sketches.quantile_partials(df.where("at >= 30000 AND at < 30001 OR at >= 40000"), ["k"], F.col("v"), 60).where("bucket >= 39900").write.mode("append").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for r in sketches.range_quantiles(stored, ["k"], {"p50": 0.5, "p99": 0.99}, 0, 86_400).collect():
        v = sorted(x for k, at, x, _ in rows if k == r.k)
        assert r.cnt == len(v) and near(r.p50, v, 0.5, 0.01) and near(r.p99, v, 0.99, 0.01)
    days = sketches.merge_quantiles(stored, ["k"], 86_400)
    assert days.count() == 2 and days.agg(F.sum("cnt")).first()[0] == len(rows)


def test_windows_take_partial_rows_not_samples(spark):
    rows, df = frame(spark)
    partials = sketches.quantile_partials(df, ["k"], F.col("v"), 600).cache()
    for r in sketches.window_quantiles(partials, ["k"], 0.9, 3600, 14_400, 1800, 3600).collect():
        v = sorted(x for k, at, x, _ in rows if k == r.k and r["at"] - 3600 <= at < r["at"])
        assert r.cnt == len(v) and near(r.value, v, 0.9, 0.01)
    assert sketches.window_quantiles(partials.limit(0), ["k"], 0.9, 0, 100, 50, 60).count() == 0


def test_distinct_values_unite_intersect_and_subtract(spark):
    rows, df = frame(spark)
    hours = sketches.distinct_partials(df, ["k"], "u", 3600)
    late = hours.unionByName(sketches.distinct_partials(df.where("at < 5000"), ["k"], "u", 3600))  # rows that come again add nothing
    exact = {k: {u for kk, _, _, u in rows if kk == k} for k in "ab"}
    for r in sketches.range_distinct(late, ["k"]).collect():
        assert abs(r.distinct_values - len(exact[r.k])) < 0.04 * len(exact[r.k])
    for r in sketches.range_unique(sketches.unique_partials(df, ["k"], "u", 3600), ["k"]).collect():
        assert abs(r.distinct_values - len(exact[r.k])) < 0.04 * len(exact[r.k])
    for r in sketches.fresh_values(late, ["k"], 43_200, 86_400).collect():
        now, before = ({u for k, at, _, u in rows if k == r.k and (at >= 43_200) == later} for later in (True, False))
        assert abs(r.fresh - len(now - before)) < 0.04 * len(now | before) and abs(r.distinct_values - len(now)) < 0.04 * len(now)
    coarse = sketches.merge_distinct(late, ["k"], 43_200)
    assert coarse.count() == 4


def test_a_funnel_of_stored_steps(spark):
    rows, df = frame(spark)
    steps = [F.col("at") < 60_000, F.col("v") > 20, F.col("k") == "a"]
    stored = sketches.step_sketches(df, [], "u", steps, 3600)
    met = [{u for k, at, v, u in rows if t(k, at, v)} for t in (lambda k, at, v: at < 60_000, lambda k, at, v: v > 20, lambda k, at, v: k == "a")]
    want = [len(met[0]), len(met[0] & met[1]), len(met[0] & met[1] & met[2])]
    got = [r.reached for r in sketches.sketch_funnel(stored, [], 3).orderBy("step").collect()]
    assert all(abs(g - w) < 0.04 * len(met[0] | met[1] | met[2]) for g, w in zip(got, want))


def test_nulls_nan_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, None, None), ("a", 2, float("nan"), None)], "k string, at int, v double, u int").withColumn("ts", F.timestamp_seconds("at"))
    assert sketches.quantile_partials(df, ["k"], F.col("v"), 60).count() == 0 == sketches.distinct_partials(df, ["k"], "u", 60).count()
    assert sketches.range_quantiles(sketches.quantile_partials(df, ["k"], F.col("v"), 60), ["k"], {"p": 0.5}).count() == 0
    nothing = sketches.step_sketches(df, [], "u", [F.col("at") < 0, F.col("at") < 0], 60)
    assert [r.reached for r in sketches.sketch_funnel(nothing, [], 2).collect()] == [0, 0]
