import pytest
from pyspark.sql import functions as F

from tidewatch.functions.core import clamp_bucket, normalize_status, threshold
from tidewatch.operators import rollup, rules
from tidewatch.plans import rules as plans

CASES = [  # state, value, critical, critical recovery, warning, warning recovery, comparator, next
    ("ok", 50, 50, None, None, None, "above", "alert"), ("ok", 40, 50, None, 40, None, "above", "warn"), ("no_data", 1, 50, None, 40, None, "above", "ok"),
    ("alert", 45, 50, 40, None, None, "above", "alert"), ("alert", 35, 50, 40, None, None, "above", "ok"), ("alert", 35, 50, 40, 30, None, "above", "warn"),
    ("warn", 35, 50, None, 40, 30, "above", "warn"), ("warn", 29, 50, None, 40, 30, "above", "ok"), ("warn", 60, 50, None, 40, 30, "above", "alert"),
    ("ok", 5, 10, None, None, None, "below", "alert"), ("alert", 12, 10, 15, None, None, "below", "alert"), ("alert", 16, 10, 15, None, None, "below", "ok"), ("other", 99, 1, None, None, None, "above", "ok"),
]


def test_states_have_hysteresis(spark):
    df = spark.createDataFrame([(s, float(v), *(None if x is None else float(x) for x in lim), c, n) for s, v, *lim, c, n in CASES], "state string, value double, a double, b double, c double, d double, cmp string, want string")
    got = df.select("want", rules.next_state(*(F.col(c) for c in ("state", "value", "a", "b", "c", "d", "cmp"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_folds_and_streams_know_the_same_states(spark):
    from itertools import product

    from tidewatch.streaming.jobs import ThresholdMonitor

    for state, value, *limits, comparator, want in CASES:
        assert rules.state_after(state, value, *limits, comparator) == want == ThresholdMonitor(*limits, comparator).after(state, value)
    every = list(product(("ok", "warn", "alert", "no_data"), (0.0, 5.0, 10.0, 15.0, 20.0), (None, 10.0), (None, 5.0, 15.0), (None, 5.0, 15.0), (None, 10.0), ("above", "below")))
    df = spark.createDataFrame([(i, s, v, *lim) for i, (s, v, *lim) in enumerate(every)], "i int, s string, v double, a double, b double, c double, d double, cmp string")
    got = dict(df.select("i", rules.next_state(*(F.col(c) for c in ("s", "v", "a", "b", "c", "d", "cmp")))).collect())
    assert all(got[i] == rules.state_after(s, v, *lim) for i, (s, v, *lim) in enumerate(every))
    quiet = ThresholdMonitor(10.0, no_data_action="resolve"), ThresholdMonitor(10.0)
    assert [m.after("alert", v) for m in quiet for v in (None, float("nan"))] == ["ok", "ok", "no_data", "no_data"]


def test_replay_of_below_missing_values_and_null_keys(spark):
    rows = [("a", None, 1, 5.0), ("a", None, 2, 12.0), ("a", None, 3, None), ("a", None, 4, 16.0), ("a", 1, 1, 20.0), (None, 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, h int, at bigint, value double")
    limits = {"critical": 10.0, "critical_recovery": 15.0, "comparator": "below"}
    got = {(r.g, r.h, r["at"]): r.state for r in rules.replay(df, limits, ["g", "h"], "at").collect()}
    assert got == {("a", None, 1): "alert", ("a", None, 2): "alert", ("a", None, 3): "no_data", ("a", None, 4): "ok", ("a", 1, 1): "ok", (None, 1, 1): "alert"}
    assert rules.replay(df.limit(0), limits, ["g", "h"], "at").count() == 0
    assert rules.ewma_anomaly(df, ["g", "h"], "at").count() == 3 and rules.ewma_anomaly(df.limit(0), ["g"], "at").count() == 0


def ewma(data, sensitivity=3.0, alpha=0.25):
    warm = data[:12]
    mean = sum(warm) / len(warm)
    var = floor = sum((x - mean) ** 2 for x in warm) / len(warm)
    floor *= 0.3
    for i, x in enumerate(data):
        std = var**0.5
        hit = i >= len(warm) and (x > mean + sensitivity * std or x < max(mean - sensitivity * std, 0))
        if i and not hit:
            diff, mean = x - mean, alpha * x + (1 - alpha) * mean
            var = max(alpha * 0.25 * diff * diff + (1 - alpha * 0.25) * var, floor)
    return mean, hit, abs(x - mean) / std if std else 0.0


def test_ewma_fold(spark):
    series = {"flat": [5.0] * 15, "spike": [float(i % 4) for i in range(20)] + [50.0], "one": [3.0], "drop": [100.0 + i % 3 for i in range(30)] + [1.0]}
    df = spark.createDataFrame([(n, i, v) for n, vs in series.items() for i, v in enumerate(vs)], "s string, i int, value double")
    for r in rules.ewma_anomaly(df, ["s"], "i").collect():
        mean, hit, dev = ewma(series[r.s])
        assert (r.mean, r.anomalous, r.deviation) == (pytest.approx(mean), hit, pytest.approx(dev))


def test_budgets(spark):
    df = spark.createDataFrame([("a", 1, 100), ("b", 20, 100), ("c", 0, 0)], "s string, bad bigint, total bigint")
    got = {r.s: (r.state, r.remaining_pct) for r in rules.budget(df, 95.0).collect()}
    assert got["a"] == ("compliant", pytest.approx(80)) and got["b"][0] == "breached" and got["c"] == ("no_data", None)


def test_composite_formula(spark):
    states = spark.createDataFrame([("r1", "alert"), ("r2", "alert"), ("r3", "ok")], "rule_id string, state string")
    fires = lambda f: rules.composite(states, {"A": "r1", "B": "r2", "C": "r3", "D": "gone"}, f).first().alerting
    assert fires(lambda m: m["A"] & m["B"] & ~m["C"]) and not fires(lambda m: m["A"] & m["B"] & m["C"])
    assert fires(lambda m: m["A"] | m["C"]) and not fires(lambda m: m["C"]) and not fires(lambda m: m["D"])


def test_slow_buckets_of_a_histogram(spark):
    df = spark.createDataFrame([("a", [5, 3, 2], [10.0, 50.0], 10)], "s string, bucket_counts array<bigint>, explicit_bounds array<double>, count bigint")
    assert rules.slo_histogram(df, ["s"], 10.0).first().bad == 5
    assert rules.slo_histogram(df, ["s"], 60.0).first().bad == 2


def test_bucket_clamp():
    hour, day = 3600, 86400
    assert clamp_bucket("1s", 0, hour) == 10 and clamp_bucket("1s", 0, 30 * day) == hour and clamp_bucket("1s", 0, 3650 * day) == day
    assert clamp_bucket("nonsense", 0, hour) == 60
    with pytest.raises(ValueError):
        clamp_bucket("1m", 5, 5)


def test_rollup_source():
    hour = 3600
    assert rollup.choose_source(0, 6 * hour, 60) == "raw" and rollup.choose_source(0, 12 * hour, 60) == "1m"
    assert rollup.choose_source(0, 7 * 86400, hour) == "1h" and rollup.choose_source(0, 12 * hour, 90) == "raw"
    assert rollup.choose_source(0, 7 * 86400, hour, needs_samples=True) == "raw"


def test_thresholds_and_statuses(spark):
    row = spark.range(1).select(threshold(F.lit(1.0), "=", 1.0).alias("a"), threshold(F.lit(2.0), "<=", 1.0).alias("b"), normalize_status(F.lit("STATUS_CODE_ERROR")).alias("c"), normalize_status(F.lit("error")).alias("d"), normalize_status(F.lit(None).cast("string")).alias("e")).first()
    assert tuple(row) == (True, False, "ERROR", "ERROR", "UNSET")


def test_detection_queries_take_logs_of_any_time(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    ids = spark.range(600_000, 600_300).withColumnRenamed("id", "doc_id")
    ids.selectExpr("doc_id", "'text' AS text", "'en' AS lang", "'src1' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda query: sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    assert run(plans.detect_severe_logs) == [("src1", "ERROR", 30), ("src1", "FATAL", 30)]
    assert run(plans.detect_brute_force) == [("src1", 30)]
    errors = [r.span_errors for r in plans.detect_logs_and_traces(spark, sf_dir).where("service_name = 'src1'").collect()]
    assert run(plans.detect_logs_and_traces) == [("src1", 60, *errors)] and errors
    assert ("noise", 2) in run(plans.detect_all)


def test_backfill_leaves_a_target_with_rows_alone(spark):
    samples = spark.createDataFrame([("s", 1_000, 1.0), ("s", 61_000, 2.0), ("s", 125_000, 9.0)], "series_key string, ts_ms bigint, value double")
    done = rollup.backfill_if_empty(samples, None, 60, 130)
    assert sorted(r.bucket for r in done.collect()) == [0, 60]
    assert rollup.backfill_if_empty(samples, done, 60, 130) is None
    assert rollup.backfill_if_empty(samples, done.limit(0), 60, 130).count() == 2


def test_lookback_and_counters():
    from tidewatch.operators import series

    assert series.lookback() == 300_000 and series.lookback(60_000, 3_600_000) == 3_600_000
    assert rules.counter_like("requests_total") and rules.counter_like("a_created") and not rules.counter_like("cpu")


def test_equal_times_roll_up_to_the_first_of_an_order(spark):
    rows = spark.createDataFrame([("a", 59_000, 1.0, 4), ("a", 59_000, 9.0, 7), ("a", 61_000, 5.0, 9), ("a", 61_000, 3.0, 8), ("a", 60_500, 8.0, 1)], "series_key string, ts_ms long, value double, n long")
    ordered = rollup.rollup(rows, 60, "n")
    assert {r.bucket: (r.last_value, r.last_order) for r in ordered.collect()} == {0: (1.0, 4), 60: (3.0, 8)}
    whole = rollup.rollup(rows.where("n % 2 = 0"), 60, "n").unionByName(rollup.rollup(rows.where("n % 2 = 1"), 60, "n"))
    assert {r.bucket: r.last_value for r in rollup.merge(whole).collect()} == {0: 1.0, 60: 3.0}
    assert {r.bucket: r.last_value for r in rollup.rollup(rows, 60).collect()} == {0: 9.0, 60: 5.0}
