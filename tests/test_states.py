from itertools import product
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import rules, states

LIMITS = {"critical": 70.0, "critical_recovery": 55.0, "warning": 60.0, "warning_recovery": 50.0}


def slow(values, limits, missing="no_data", state="ok"):
    """State by state, without maps."""
    c, cr, w, wr = (limits.get(k) for k in ("critical", "critical_recovery", "warning", "warning_recovery"))
    over = lambda v, x: x is not None and (v < x if limits.get("comparator") == "below" else v >= x)
    back = lambda v, x: x is not None and not over(v, x)
    out = []
    for v in values:
        if v is None or v != v:
            state = missing
        elif state == "alert":
            state = ("warn" if over(v, w) else "ok") if back(v, c if cr is None else cr) else "alert"
        elif state == "warn":
            state = "alert" if over(v, c) else "ok" if back(v, w if wr is None else wr) else "warn"
        else:
            state = "alert" if over(v, c) else "warn" if over(v, w) else "ok"
        out.append(state)
    return out


def test_maps_compose_like_their_states():
    every = sorted({*states.TRANSITIONS, *states.MISSING.values(), states.SAME})
    to = lambda m, s: m >> 2 * s & 3
    for a, b in product(every, every):
        both = sum(to(b, to(a, s)) << 2 * s for s in range(4))
        assert all(to(both, s) == to(b, to(a, s)) for s in range(4))


def test_columns_compose_and_apply_as_numbers_do(spark):
    every = sorted({*states.TRANSITIONS, *states.MISSING.values(), states.SAME})
    df = spark.createDataFrame(list(product(every, every)), "a int, b int")
    to = lambda m, s: m >> 2 * s & 3
    for r in df.select("a", "b", states.then(F.col("a"), F.col("b")).alias("c"), states.applied(F.col("a"), F.lit("warn")).alias("w"), states.applied(F.col("a"), F.lit("odd")).alias("o")).collect():
        assert all(to(r.c, s) == to(r.b, to(r.a, s)) for s in range(4)) and r.w == states.STATES[to(r.a, 2)] and r.o == "ok"


@pytest.mark.parametrize("limits", [LIMITS, {"critical": 70.0}, {"critical": 40.0, "critical_recovery": 55.0, "warning": 60.0, "comparator": "below"}, {"warning": 50.0}])
def test_long_histories_over_many_tasks(spark, limits):
    draw = random.Random(7)
    series = {"long": 100_000, "short": 3, "one": 1, None: 300}
    rows = [(k, i, None if draw.random() < 0.01 else float("nan") if draw.random() < 0.01 else draw.uniform(30, 90)) for k, n in series.items() for i in range(n)]
    want = {(k, i): s for k, n in series.items() for i, s in enumerate(slow([v for kk, _, v in rows if kk == k], limits))}
    draw.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = states.replay(spark.createDataFrame(rows, "k string, i int, value double").repartition(6), limits, ["k"], "i")
        assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()
        got = {(r.k, r.i): r.state for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_ties_go_by_value_and_groups_may_be_whole(spark):
    df = spark.createDataFrame([(1, 65.0), (1, None), (1, 75.0), (2, 58.0)], "i int, value double")
    got = [tuple(r) for r in states.replay(df, LIMITS, [], "i", "resolve").orderBy("i", "value").collect()]
    assert got == [(1, None, "ok"), (1, 65.0, "warn"), (1, 75.0, "alert"), (2, 58.0, "alert")]
    assert states.replay(df, LIMITS, [], "i", initial="alert").where("i = 2").first().state == "alert"


def test_the_machine_of_columns_is_that_of_numbers(spark):
    rows = list(product(states.STATES, (0.0, 50.0, 55.0, 60.0, 70.0, 80.0)))
    df = spark.createDataFrame(rows, "s string, v double")
    lit = [F.lit(LIMITS[k]) for k in ("critical", "critical_recovery", "warning", "warning_recovery")]
    for r in df.select("s", "v", rules.next_state(F.col("s"), F.col("v"), *lit, F.lit("above")).alias("n")).collect():
        assert r.n == states.state_after(r.s, r.v, *LIMITS.values()) == slow([r.v], LIMITS, state=r.s)[0]
