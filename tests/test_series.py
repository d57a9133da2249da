import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.core import series_key
from tidewatch.operators import series as ts

SAMPLE = "labels map<string,string>, ts_ms bigint, value double"


def frame(spark, points, **labels):
    rows = [(labels or {"a": "1"}, int(t * 1000), float(v)) for t, v in points]
    return spark.createDataFrame(rows, SAMPLE).withColumn("series_key", series_key("labels"))


def window(spark, points, *names, param=None):
    end = max((t for t, _ in points), default=0)
    grid = ts.Grid(int(end * 1000), int(end * 1000), 0)
    rows = ts.range_functions(frame(spark, points), grid, 10_000_000, {n: param for n in names}).collect()
    return [rows[0][n] for n in names] if rows else None


REGULAR = list(zip((5, 15, 24, 36, 49, 60, 78, 80, 97, 115, 120, 130), (123, 34, 44, 21, 54, 34, 99, 12, 44, 32, 34, 34)))


def test_counter_functions(spark):
    assert window(spark, REGULAR, "rate")[0] == pytest.approx(2.2)
    reset = [(0, 0), (10, 5), (20, 10), (30, 3), (40, 8)]
    rate, resets, increase, irate, changes = window(spark, reset, "rate", "resets", "increase", "irate", "changes")
    assert (rate, resets, increase, irate, changes) == (pytest.approx(18 / 40), 1, 18, 0.5, 4)


def test_windows_of_one_and_two_samples(spark):
    names = ("rate", "irate", "increase", "delta", "idelta", "deriv", "last_over_time", "count_over_time", "stddev_over_time")
    assert window(spark, [(10, 7)], *names) == [None] * 6 + [7, 1, 0]
    assert window(spark, [(10, 7), (20, 4)], *names)[:6] == [pytest.approx(0.4), pytest.approx(0.4), 4, -3, -3, pytest.approx(-0.3)]
    assert window(spark, [], "rate") is None


def test_nan_is_left_out_of_extremes_and_quantiles_interpolate(spark):
    low, high, q = window(spark, [(1, 5), (2, math.nan), (3, 2)], "min_over_time", "max_over_time", "quantile_over_time", param=0.0)
    assert (low, high) == (2, 5)
    assert window(spark, [(t, t) for t in range(1, 6)], "quantile_over_time", param=0.9)[0] == pytest.approx(4.6)
    assert window(spark, [(0, 0), (10, 10), (20, 20)], "predict_linear", param=60)[0] == pytest.approx(80)


def brute_instant(points, grid):
    half, out = grid.step_ms / 2, {}
    for k in range(grid.steps):
        t = grid.start_ms + k * grid.step_ms
        near = [(p, v) for p, v in points if t - half <= p * 1000 <= t + half]
        if near:
            out[k] = max(near)[1]
    return out


@pytest.mark.parametrize("points,grid", [
    ([(15 * i, i) for i in range(40)], ts.Grid(0, 570_000, 30_000)),
    ([(3, 1), (14.5, 2), (15, 2.5), (61, 3), (200, 4), (201, 5)], ts.Grid(0, 200_000, 10_000)),
    ([(5, 1), (15, 2), (25, 3)], ts.Grid(0, 30_000, 10_000)),
])
def test_instant_select_agrees_with_a_scan(spark, points, grid):
    got = {r.k: r.value for r in ts.instant_select(frame(spark, points), grid).collect()}
    assert got == brute_instant(points, grid)


def test_absent_windows_of_known_series(spark):
    got = ts.absent_over_time(frame(spark, [(0, 1), (50, 1)]), ts.Grid(0, 60_000, 10_000), 10_000).collect()
    assert sorted(r.k for r in got) == [2, 3, 4]


def gridded(spark, *series):
    rows = [(labels, k, float(v)) for labels, values in series for k, v in values]
    return spark.createDataFrame(rows, "labels map<string,string>, k int, value double").withColumn("series_key", series_key("labels"))


def test_aggregation_and_ranking(spark):
    two = gridded(spark, ({"s": "a", "i": "1"}, [(0, 5), (1, 10)]), ({"s": "a", "i": "2"}, [(0, 3), (1, 7)]))
    assert {r.k: r.value for r in ts.aggregate(two, "sum").collect()} == {0: 8, 1: 17}
    assert {(r.series_key, r.value) for r in ts.aggregate(two, "topk", param=1).collect()} == {('{"i":"1","s":"a"}', 5.0), ('{"i":"1","s":"a"}', 10.0)}
    assert ts.aggregate(two, "sum", without=["i"]).first().labels == {"s": "a"}
    assert ts.aggregate(two.limit(0), "sum").count() == 0


def test_scalar_functions(spark):
    values = gridded(spark, ({"a": "1"}, list(enumerate([-2.5, 0.0, 2.5, math.nan, math.inf]))))
    run = lambda name, *args: [r.value for r in ts.scalar(values, name, *args).orderBy("k").collect()]
    assert run("round")[:3] == [-3, 0, 3] and run("sgn") == [-1, 0, 1, 0, 1]
    assert run("ln")[1] == -math.inf and math.isnan(run("ln")[0])
    assert run("clamp_min", 1.0)[:4] == [1, 1, 2.5, 1] and run("clamp", 0.0, 2.0)[:4] == [0, 0, 2, 0]
    with pytest.raises(ValueError):
        run("clamp", 2.0, 1.0)


def test_binary_operators_follow_ieee(spark):
    left = gridded(spark, ({"a": "1", "__name__": "x"}, [(0, 6), (1, 1), (2, math.nan)]))
    right = gridded(spark, ({"a": "1", "__name__": "y"}, [(0, 0), (1, 2), (2, 1)]))
    div = {r.k: r.value for r in ts.binary(left, right, "/").collect()}
    assert math.isnan(div[0]) and div[1] == 0.5
    assert {r.k for r in ts.binary(left, right, ">").collect()} == {0}
    assert {r.k for r in ts.binary(left, right, "!=").collect()} == {0, 1, 2}
    assert {r.k: r.value for r in ts.binary(left, right, "<", as_bool=True).collect()} == {0: 0, 1: 1, 2: 0}


def test_histogram_quantile(spark):
    buckets = [({"le": le, "j": "x"}, [(0, n)]) for le, n in (("1", 10), ("2", 30), ("+Inf", 40))]
    assert ts.histogram_quantile(gridded(spark, *buckets), 0.5).first().value == pytest.approx(1.5)
    assert ts.histogram_quantile(gridded(spark, *[(b, [(0, 0)]) for b, _ in buckets]), 0.5).count() == 0


def test_set_operations_are_on_whole_series(spark):
    left = gridded(spark, ({"a": "1"}, [(0, 1), (1, 2)]), ({"a": "2"}, [(0, 3)]))
    right = gridded(spark, ({"a": "1"}, [(5, 9)]), ({"a": "3"}, [(0, 4)]))
    keys = lambda df: sorted({(r.labels["a"], r.k) for r in df.collect()})
    assert keys(ts.set_operation(left, right, "and")) == [("1", 0), ("1", 1)]
    assert keys(ts.set_operation(left, right, "unless")) == [("2", 0)]
    assert keys(ts.set_operation(left, right, "or")) == [("1", 0), ("1", 1), ("2", 0), ("3", 0)]


def test_series_keys_do_not_depend_on_order(spark):
    one, two = (spark.sql(f"SELECT map({m}) AS labels").select(series_key(F.col("labels"))).first()[0] for m in ("'b','1','a','2'", "'a','2','b','1'"))
    assert one == two == '{"a":"2","b":"1"}'


def brute_window(points, lo, hi):
    """The functions of one window, from its samples in order."""
    inside = sorted((t, v) for t, v in points if lo <= t <= hi)
    if not inside:
        return None
    values = [v for _, v in inside]
    n, mean = len(values), sum(values) / len(values)
    pairs = list(zip(inside, inside[1:]))
    inc = [b[1] if b[1] < a[1] else b[1] - a[1] for a, b in pairs]
    span = (inside[-1][0] - inside[0][0]) / 1000
    xs = [t / 1000 for t, _ in inside]
    mx = sum(xs) / n
    sxx = sum((x - mx) ** 2 for x in xs)
    gap = (inside[-1][0] - inside[-2][0]) / 1000 if n > 1 else 0
    return {
        "sum_over_time": sum(values), "avg_over_time": mean, "min_over_time": min(values), "max_over_time": max(values), "count_over_time": n, "stdvar_over_time": sum((v - mean) ** 2 for v in values) / n,
        "last_over_time": values[-1], "first_over_time": values[0], "delta": values[-1] - values[0] if n > 1 else None, "idelta": values[-1] - values[-2] if n > 1 else None,
        "increase": sum(inc) if span > 0 else None, "rate": sum(inc) / span if span > 0 else None, "irate": inc[-1] / gap if gap > 0 else None,
        "resets": sum(b[1] < a[1] for a, b in pairs), "changes": sum(a[1] != b[1] for a, b in pairs), "deriv": sum((x - mx) * (v - mean) for x, v in zip(xs, values)) / sxx if sxx > 0 else None,
    }


@pytest.mark.parametrize("range_ms", [20_000, 25_000, 7_000, 60_000])
def test_tiles_agree_with_whole_windows(spark, range_ms):
    import random

    pick = random.Random(range_ms)
    points = [(pick.choice((0, 2500, 5000, 10_000, 13_000)) + 10_000 * pick.randrange(-3, 14), float(pick.randrange(1, 9))) for _ in range(60)]
    points += [(20_000, 3.0), (20_000, 3.0), (35_000, 2.0), (200_000, 5.0)]  # equal samples, ends of windows, and one after them all
    grid = ts.Grid(0, 120_000, 10_000)
    rows = frame(spark, [(t / 1000, v) for t, v in points])
    want = {k: w for k in range(grid.steps) if (w := brute_window(points, k * 10_000 - range_ms, k * 10_000))}
    names = [*next(iter(want.values())), "quantile_over_time"]
    got = {r.k: r for r in ts.range_functions(rows, grid, range_ms, {n: 0.0 for n in names}).collect()}
    assert got.keys() == want.keys()
    for k, window_ in want.items():
        assert got[k].quantile_over_time == window_["min_over_time"]
        for name, value in window_.items():
            assert got[k][name] == (None if value is None else pytest.approx(value, abs=1e-9)), (k, name)


def test_long_ranges_merge_at_most_two_pieces(spark):
    """A range of a thousand steps, sparse and dense series, values far from zero and some that are not finite."""
    import random

    pick = random.Random(4)
    grid, range_ms = ts.Grid(0, 3_000_000, 1000), 1_000_000
    series = {"dense": [(1000 * i + pick.randrange(1000), 1e9 + pick.random()) for i in range(-1000, 3000, 2)], "sparse": [(pick.randrange(-900_000, 3_000_000), float(pick.randrange(5))) for _ in range(40)], "one": [(1_500_000, 7.0)]}
    rows = None
    for name, points in series.items():
        one = frame(spark, [(t / 1000, v) for t, v in points], s=name)
        rows = one if rows is None else rows.unionByName(one)
    pieces = ts._pieces(ts._tiles(ts.range_select(rows, grid, range_ms).select("series_key", "labels", "ts_ms", "value"), grid, range_ms, True), grid, range_ms, True)
    assert pieces.groupBy("series_key", "k").count().agg(F.max("count")).first()[0] == 2
    names = ["sum_over_time", "avg_over_time", "min_over_time", "count_over_time", "stdvar_over_time", "last_over_time", "first_over_time", "increase", "rate", "irate", "resets", "changes", "deriv"]
    got = {(r.labels["s"], r.k): r for r in ts.range_functions(rows, grid, range_ms, {n: None for n in names}).collect()}
    for name, points in series.items():
        for k in [0, 1, 999, 1000, 1001, 1999, 2001, 3000, *(pick.randrange(3001) for _ in range(25))]:
            want = brute_window(points, k * 1000 - range_ms, k * 1000)
            assert (want is None) == ((name, k) not in got)
            for f in names if want else ():
                assert got[name, k][f] == (None if want[f] is None else pytest.approx(want[f], rel=1e-6, abs=1e-6)), (name, k, f)


def test_a_value_that_is_no_number_spoils_only_its_windows(spark):
    points = [(float(t), math.nan if t == 50 else float(t % 7)) for t in range(0, 200, 10)]
    grid = ts.Grid(0, 190_000, 10_000)
    for r in ts.range_functions(frame(spark, points), grid, 40_000, {n: None for n in ("stddev_over_time", "sum_over_time", "deriv", "min_over_time")}).collect():
        spoiled = 50_000 <= r.k * 10_000 <= 90_000
        assert (math.isnan(r.stddev_over_time), math.isnan(r.sum_over_time)) == (spoiled, spoiled) and not math.isnan(r.min_over_time)
        assert r.deriv is None if r.k == 0 else math.isnan(r.deriv) == spoiled


def test_plain_sums_never_sort_their_samples(spark):
    """Samples of a task meet in a hash table of tiles; labels that differ under one key, such as unset ones, are one series."""
    rows = spark.createDataFrame([("a", {"x": "1"}, i * 1000, float(i)) for i in range(50)] + [("a", {"x": "1", "y": None}, 50_000, math.nan), ("a", {"x": "1"}, 51_000, None)], "series_key string, labels map<string,string>, ts_ms long, value double")
    grid = ts.Grid(10_000, 60_000, 10_000)
    out = ts.range_functions(rows, grid, 30_000, dict.fromkeys(sorted(ts._PLAIN)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[series_key#" in plan and "partial_sum(value#" in plan
    assert not any("SortAggregate" in line and "partial_sum(value#" in line for line in plan.splitlines())
    got = {r.k: r for r in out.collect()}
    assert sorted(got) == list(range(grid.steps))
    for k, r in got.items():
        held = [v for v in range(50) if 10_000 * k - 20_000 <= v * 1000 <= 10_000 * (k + 1)]
        assert (r.min_over_time, r.max_over_time) == (min(held), max(held)) and r.present_over_time == 1
        assert r.count_over_time == len(held) + sum(10_000 * k - 20_000 <= at <= 10_000 * (k + 1) for at in (50_000, 51_000))
        assert math.isnan(r.sum_over_time) if k >= 4 else r.sum_over_time == sum(held)
