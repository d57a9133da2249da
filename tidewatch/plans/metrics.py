"""Queries of the time-series algebra and of rollups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewatch.functions.predicates import label_matchers
from tidewatch.operators import expressions, explore, rollup, rules
from tidewatch.operators import series as ts
from tidewatch.sources import bind
from tidewatch.sources.bind import COUNTERS_SQL, SAMPLES_SQL

QUERIES, ORACLES = {}, {}
START, END, STEP, RANGE = 1704412800000, 1705017600000, 21_600_000, 86_400_000  # a week by six hours, over a day
GRID = ts.Grid(START, END, STEP)
N = GRID.steps
STEPS_SQL = f"steps AS (SELECT CAST(range AS INT) AS k, {START} + range * {STEP} AS t FROM range({N}))"
WINDOWS_SQL = f"""{STEPS_SQL}, w AS (SELECT series_key, k, t, ts_ms, value AS v, lag(value) OVER o AS p, lag(ts_ms) OVER o AS pt FROM samples JOIN steps ON ts_ms BETWEEN t - {RANGE} AND t
    WINDOW o AS (PARTITION BY series_key, k ORDER BY ts_ms, value))"""
INSTANT_SQL = f"{STEPS_SQL}, inst AS (SELECT series_key, service_name, shard, k, max_by(value, ts_ms) AS value FROM samples JOIN steps ON ts_ms BETWEEN t - {STEP // 2} AND t + {STEP // 2} GROUP BY 1, 2, 3, 4)"
INC = "CASE WHEN p IS NULL THEN 0 WHEN v < p THEN v ELSE v - p END"
TWO = "CASE WHEN count(*) >= 2 THEN {} END"
X = f"((ts_ms - {START}) / 1000.0)"
#: name, parameter, counters or gauges, SQL over a window, digits.
RANGE_QUERIES = [
    ("rate", None, True, f"CASE WHEN count(*) >= 2 AND max(ts_ms) > min(ts_ms) THEN sum({INC}) / ((max(ts_ms) - min(ts_ms)) / 1000.0) END", 6),
    ("irate", None, True, f"CASE WHEN count(*) >= 2 AND max(ts_ms) > max_by(pt, ts_ms) THEN max_by({INC}, ts_ms) / ((max(ts_ms) - max_by(pt, ts_ms)) / 1000.0) END", 6),
    ("increase", None, True, f"CASE WHEN count(*) >= 2 AND max(ts_ms) > min(ts_ms) THEN sum({INC}) END", 4),
    ("sum_over_time", None, False, "sum(v)", 6), ("avg_over_time", None, False, "avg(v)", 6), ("min_over_time", None, False, "min(v)", 6), ("max_over_time", None, False, "max(v)", 6), ("count_over_time", None, False, "CAST(count(*) AS DOUBLE)", 6),
    ("stddev_over_time", None, False, "stddev_pop(v)", 6), ("stdvar_over_time", None, False, "var_pop(v)", 7), ("quantile_over_time", 0.9, False, "quantile_cont(v, 0.9)", 6), ("last_over_time", None, False, "max_by(v, ts_ms)", 6), ("first_over_time", None, False, "min_by(v, ts_ms)", 6),
    ("delta", None, False, TWO.format("max_by(v, ts_ms) - min_by(v, ts_ms)"), 6), ("idelta", None, False, TWO.format("max_by(v - p, ts_ms)"), 6), ("deriv", None, False, f"CASE WHEN count(DISTINCT ts_ms) >= 2 THEN regr_slope(v, {X}) END", 6),
    ("predict_linear", 3600.0, False, f"CASE WHEN count(DISTINCT ts_ms) >= 2 THEN regr_slope(v, {X}) * (max({X}) + 3600) + regr_intercept(v, {X}) END", 3), ("changes", None, False, "CAST(count(*) FILTER (p IS NOT NULL AND abs(v - p) > 2.220446049250313e-16) AS DOUBLE)", 6),
    ("resets", None, True, "CAST(count(*) FILTER (v < p) AS DOUBLE)", 6), ("present_over_time", None, False, "1.0", 6),
]


def _shown(df, digits: int = 6):
    return df.select("series_key", "k", (F.round("value", digits) + F.lit(0.0)).alias("value"))  # no negative zero


def _range(name, param, counter, digits):
    def run(spark, sf_dir):
        rows = (bind.counters if counter else bind.samples)(spark, sf_dir)
        return _shown(ts.range_function(rows, GRID, RANGE, name, param), digits)

    return run


for _name, _param, _counter, _sql, _digits in RANGE_QUERIES:
    QUERIES[_name] = _range(_name, _param, _counter, _digits)
    ORACLES[_name] = f"WITH {COUNTERS_SQL if _counter else SAMPLES_SQL}, {WINDOWS_SQL} SELECT series_key, k, round({_sql}, {_digits}) + 0.0 AS value FROM w GROUP BY 1, 2 HAVING ({_sql}) IS NOT NULL"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("absent_over_time", f"WITH {SAMPLES_SQL}, {STEPS_SQL}, near AS (SELECT DISTINCT series_key, k FROM samples JOIN steps ON ts_ms BETWEEN t - 3600000 AND t) SELECT series_key, k, 1.0 AS value FROM (SELECT DISTINCT series_key FROM samples), steps WHERE (series_key, k) NOT IN (SELECT (series_key, k) FROM near)")
def absent_over_time(spark, sf_dir):
    return _shown(ts.range_function(bind.samples(spark, sf_dir), GRID, 3_600_000, "absent_over_time"))


@query("range_bundle", f"WITH {COUNTERS_SQL}, {WINDOWS_SQL} SELECT series_key, k, round(sum({INC}), 4) AS increase, round(avg(v), 6) AS mean, CAST(count(*) FILTER (v < p) AS DOUBLE) AS resets FROM w GROUP BY 1, 2 HAVING count(*) >= 2 AND max(ts_ms) > min(ts_ms)")
def range_bundle(spark, sf_dir):
    """Several functions of one window in one pass."""
    out = ts.range_functions(bind.counters(spark, sf_dir), GRID, RANGE, {"increase": None, "avg_over_time": None, "resets": None})
    return out.where("increase IS NOT NULL").select("series_key", "k", F.round("increase", 4).alias("increase"), F.round("avg_over_time", 6).alias("mean"), "resets")


@query("instant_select", f"WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT series_key, k, round(value, 6) AS value FROM inst")
def instant_select(spark, sf_dir):
    return _shown(ts.instant_select(bind.samples(spark, sf_dir), GRID))


@query("instant_at", f"WITH {SAMPLES_SQL} SELECT series_key, 0 AS k, round(max_by(value, ts_ms), 6) AS value FROM samples WHERE ts_ms BETWEEN {END} - 3600000 AND {END} GROUP BY 1")
def instant_at(spark, sf_dir):
    return _shown(ts.instant_at(bind.samples(spark, sf_dir), END, 3_600_000))


@query("range_select", f"WITH {SAMPLES_SQL} SELECT series_key, count(*) AS samples, round(sum(value), 6) AS total FROM samples WHERE ts_ms BETWEEN {START - RANGE} AND {END} GROUP BY 1")
def range_select(spark, sf_dir):
    return ts.range_select(bind.samples(spark, sf_dir), GRID, RANGE).groupBy("series_key").agg(F.count("*").alias("samples"), F.round(F.sum("value"), 6).alias("total"))


@query("label_matchers", f"WITH {SAMPLES_SQL} SELECT series_key, count(*) AS samples FROM samples WHERE service_name <> 'view' AND regexp_matches(shard, '[0-2]') AND NOT regexp_matches(service_name, '^s') GROUP BY 1")
def label_matchers_query(spark, sf_dir):
    kept = bind.samples(spark, sf_dir).where(label_matchers([("__name__", "=", "app.value"), ("job", "!=", "view"), ("shard", "=~", "[0-2]"), ("service_name", "!~", "^s"), ("missing", "=", "")]))
    return kept.groupBy("series_key").agg(F.count("*").alias("samples"))


@query("series_list", f"WITH {SAMPLES_SQL} SELECT DISTINCT series_key FROM samples")
def series_list(spark, sf_dir):
    return explore.series_list(bind.samples(spark, sf_dir))


@query("label_names", "SELECT unnest(['__name__', 'service_name', 'shard']) AS label")
def label_names(spark, sf_dir):
    return explore.label_names(bind.samples(spark, sf_dir))


@query("label_values", f"WITH {SAMPLES_SQL} SELECT DISTINCT shard AS value FROM samples")
def label_values(spark, sf_dir):
    return explore.label_values(bind.samples(spark, sf_dir), "shard")


AGG_SQL = {
    "sum": "sum(value)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(*) AS DOUBLE)", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)", "quantile": "quantile_cont(value, 0.75)", "group": "1.0",
    "count_values": "CAST(count(DISTINCT floor(value * 1e6)) AS DOUBLE)",
}


def _across(op):
    return lambda spark, sf_dir: _shown(ts.aggregate(ts.instant_select(bind.samples(spark, sf_dir), GRID), op, by=["service_name"], param=0.75), 3 if op == "stdvar" else 5)


for _op, _sql in AGG_SQL.items():
    QUERIES[f"agg_{_op}"] = _across(_op)
    ORACLES[f"agg_{_op}"] = f"""WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT '{{"service_name":"' || service_name || '"}}' AS series_key, k, round({_sql}, {3 if _op == 'stdvar' else 5}) + 0.0 AS value FROM inst GROUP BY service_name, k"""


@query("agg_sum_without", f"""WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT '{{"shard":"' || shard || '"}}' AS series_key, k, round(sum(value), 5) AS value FROM inst GROUP BY shard, k""")
def agg_sum_without(spark, sf_dir):
    return _shown(ts.aggregate(ts.instant_select(bind.samples(spark, sf_dir), GRID), "sum", without=["service_name"]), 5)


def _ranked(op):
    return lambda spark, sf_dir: _shown(ts.aggregate(ts.instant_select(bind.samples(spark, sf_dir), GRID), op, by=["service_name"], param=2))


for _op, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    QUERIES[f"agg_{_op}"] = _ranked(_op)
    ORACLES[f"agg_{_op}"] = f"""WITH {SAMPLES_SQL}, {INSTANT_SQL}, l AS (SELECT series_key, service_name, max_by(value, k) AS v FROM inst GROUP BY 1, 2), b AS (SELECT series_key, row_number() OVER (PARTITION BY service_name ORDER BY v {_dir}, series_key) AS n FROM l)
    SELECT series_key, k, round(value, 6) AS value FROM inst WHERE series_key IN (SELECT series_key FROM b WHERE n <= 2)"""

#: name, arguments, SQL of v; functions of numbers up to 1 see v / 1000.
SCALAR_QUERIES = [
    ("abs", (), "abs(v)"), ("ceil", (), "ceil(v)"), ("floor", (), "floor(v)"), ("round", (0.5,), "round(v / 0.5) * 0.5"), ("sqrt", (), "sqrt(v)"), ("exp", (), "exp(v)"), ("ln", (), "CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"),
    ("log2", (), "CASE WHEN v > 0 THEN log2(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"), ("log10", (), "CASE WHEN v > 0 THEN log10(v) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"), ("sgn", (), "CAST(sign(v) AS DOUBLE)"),
    ("clamp_min", (20.0,), "greatest(v, 20.0)"), ("clamp_max", (50.0,), "least(v, 50.0)"), ("clamp", (20.0, 50.0), "least(greatest(v, 20.0), 50.0)"), ("sin", (), "sin(v)"), ("cos", (), "cos(v)"), ("asin", (), "asin(v)"), ("acos", (), "acos(v)"), ("atan2", (2.0,), "atan2(v, 2.0)"),
    ("sinh", (), "sinh(v)"), ("cosh", (), "cosh(v)"), ("asinh", (), "asinh(v)"), ("acosh", (), "acosh(v)"), ("atanh", (), "atanh(v)"), ("deg", (), "degrees(v)"), ("rad", (), "radians(v)"), ("pi", (), "pi()"), ("neg", (), "-v"), ("timestamp", (), f"({START} + k * {STEP}) / 1000.0"),
]
_SMALL = {"exp", "asin", "acos", "atanh", "sinh", "cosh"}


def _scalar(name, args):
    def run(spark, sf_dir):
        rows = ts.instant_select(bind.samples(spark, sf_dir), GRID)
        moved = ts.with_scalar(rows, "/", 10_000.0) if name in _SMALL else ts.with_scalar(rows, "+", 1.0) if name == "acosh" else rows
        return _shown(ts.scalar(moved, name, *args, grid=GRID), 5)

    return run


for _name, _args, _sql in SCALAR_QUERIES:
    _v = "value / 10000.0" if _name in _SMALL else "value + 1" if _name == "acosh" else "value"
    QUERIES[f"scalar_{_name}"] = _scalar(_name, _args)
    ORACLES[f"scalar_{_name}"] = f"WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT series_key, k, round({_sql}, 5) AS value FROM (SELECT series_key, k, {_v} AS v FROM inst)"

_NAMES = {"+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod", "^": "pow", "==": "eq", "!=": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge"}


def _binary(op):
    def run(spark, sf_dir):
        one = ts.with_scalar(ts.instant_select(bind.samples(spark, sf_dir), GRID), "/", 50.0)
        each = ts.scalar(ts.aggregate(one, "max", by=["service_name"]), "ceil")
        return _shown(ts.binary(ts.scalar(one, "ceil"), each, op, on=["service_name"], group="left"), 5)

    return run


for _op, _name in _NAMES.items():
    _e = {"^": "pow(l, r)", "/": "CASE WHEN r = 0 THEN 'nan'::DOUBLE ELSE l / r END", "%": "CASE WHEN r = 0 THEN 'nan'::DOUBLE ELSE l % r END"}.get(_op, f"l {_op} r" if _op in "+-*" else "l")
    _w = "" if _op in ts._ARITHMETIC else f" WHERE l {'=' if _op == '==' else _op} r"
    QUERIES[f"bin_{_name}"] = _binary(_op)
    ORACLES[f"bin_{_name}"] = f"""WITH {SAMPLES_SQL}, {INSTANT_SQL}, c AS (SELECT service_name, shard, k, value / 50.0 AS x FROM inst), m AS (SELECT service_name, k, ceil(max(x)) AS r FROM c GROUP BY 1, 2),
    j AS (SELECT '{{"service_name":"' || service_name || '","shard":"' || shard || '"}}' AS series_key, k, ceil(x) AS l, r FROM c JOIN m USING (service_name, k)) SELECT series_key, k, round({_e}, 5) AS value FROM j{_w}"""


@query("bin_scalar_bool", f"WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT series_key, k, CASE WHEN 40.0 > value THEN 1.0 ELSE 0.0 END AS value FROM inst")
def bin_scalar_bool(spark, sf_dir):
    return _shown(ts.with_scalar(ts.instant_select(bind.samples(spark, sf_dir), GRID), ">", 40.0, scalar_left=True, as_bool=True))


@query("bin_scalar_filter", f"WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT series_key, k, round(value, 6) AS value FROM inst WHERE value >= 40.0")
def bin_scalar_filter(spark, sf_dir):
    return _shown(ts.with_scalar(ts.instant_select(bind.samples(spark, sf_dir), GRID), ">=", 40.0))


@query("bin_steps", f"WITH {SAMPLES_SQL}, {INSTANT_SQL}, t AS (SELECT k, sum(value) AS s FROM inst GROUP BY 1) SELECT series_key, k, round(value / s, 6) AS value FROM inst JOIN t USING (k)")
def bin_steps(spark, sf_dir):
    rows = ts.instant_select(bind.samples(spark, sf_dir), GRID)
    return _shown(ts.with_steps(rows, "/", ts.aggregate(rows, "sum")))


@query("bin_constant", f"WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT series_key, k, round(value * 3.0, 6) AS value FROM inst")
def bin_constant(spark, sf_dir):
    return _shown(ts.with_steps(ts.instant_select(bind.samples(spark, sf_dir), GRID), "*", ts.with_scalar(ts.constant(spark, GRID, 1.5), "*", 2.0)))


def _set(op):
    def run(spark, sf_dir):
        rows = ts.instant_select(bind.samples(spark, sf_dir), GRID)
        left, right = rows.where(F.col("labels")["shard"] != "0"), rows.where(F.col("labels")["shard"] < "3")
        return _shown(ts.set_operation(left, right, op))

    return run


for _op, _keep in (("and", "shard IN ('1', '2')"), ("unless", "shard IN ('3', '4')"), ("or", "TRUE")):
    QUERIES[f"vec_{_op}"] = _set(_op)
    ORACLES[f"vec_{_op}"] = f"WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT series_key, k, round(value, 6) AS value FROM inst WHERE {_keep}"


@query("vec_merge", f"WITH {SAMPLES_SQL}, {INSTANT_SQL} SELECT series_key, k, round(value, 6) AS value FROM inst")
def vec_merge(spark, sf_dir):
    rows = bind.samples(spark, sf_dir)
    return _shown(ts.instant_select(ts.merge_series(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")), GRID))


@query(
    "histogram_quantile",
    f"""WITH {STEPS_SQL}, b AS (SELECT event_type AS service, le, k, CAST(count(*) FILTER (value <= le) AS DOUBLE) AS n FROM events JOIN steps ON epoch_ms(ts) BETWEEN t - {RANGE} AND t, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 200.0, 1e308]) AS le) GROUP BY ALL),
    c AS (SELECT *, coalesce(lag(n) OVER o, 0) AS pn, coalesce(lag(le) OVER o, 0) AS ple, 0.9 * max(n) OVER (PARTITION BY service, k) AS target FROM b WINDOW o AS (PARTITION BY service, k ORDER BY le)),
    f AS (SELECT *, row_number() OVER (PARTITION BY service, k ORDER BY le) AS i FROM c WHERE n >= target AND target > 0)
    SELECT '{{"service_name":"' || service || '"}}' AS series_key, k, round(CASE WHEN n > pn THEN CASE WHEN le > 1e300 THEN 'inf'::DOUBLE ELSE ple + (le - ple) * (target - pn) / (n - pn) END ELSE ple END, 6) AS value FROM f WHERE i = 1""",
)
def histogram_quantile(spark, sf_dir):
    return _shown(ts.histogram_quantile(_bucket_counts(spark, sf_dir), 0.9))


@query("histogram_quantile_last", f"WITH h AS ({ORACLES['histogram_quantile']}) SELECT * FROM h WHERE k = (SELECT max(k) FROM h h2 WHERE h2.series_key = h.series_key)")
def histogram_quantile_last(spark, sf_dir):
    return _shown(ts.histogram_quantile(_bucket_counts(spark, sf_dir), 0.9, last_only=True))


def _bucket_counts(spark, sf_dir):
    bounds = [10.0, 25.0, 50.0, 100.0, 200.0, math.inf]
    rows = bind.samples(spark, sf_dir).withColumn("ts_ms", bind.nearest_ms()).withColumn("bound", F.explode(F.array(*map(F.lit, bounds))))
    le = F.when(F.col("bound") > 1e300, "+Inf").otherwise(F.col("bound").cast("string"))
    labels = F.create_map(F.lit("__name__"), F.lit("app.value_bucket"), F.lit("service_name"), F.col("service_name"), F.lit("le"), le)
    counted = rows.select(labels.alias("labels"), "ts_ms", F.when(F.col("value") <= F.col("bound"), 1.0).otherwise(0.0).alias("value")).withColumn("series_key", ts.series_key("labels"))
    return ts.range_function(counted, GRID, RANGE, "sum_over_time")


ROLL = "round(sum(value) / count(*), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max_by(value, ts_ms), 6) AS last, count(*) AS cnt"


def _rolled(df):
    return rollup.finished(df).withColumns({c: F.round(c, 6) for c in ("avg", "min", "max", "last")})


@query("rollup_1m", f"WITH {SAMPLES_SQL} SELECT series_key, ts_ms // 60000 * 60 AS bucket, {ROLL} FROM samples GROUP BY 1, 2")
def rollup_1m(spark, sf_dir):
    return _rolled(rollup.rollup(bind.samples(spark, sf_dir), 60, "event_id"))


@query("rollup_merge", f"WITH {SAMPLES_SQL} SELECT series_key, ts_ms // 3600000 * 3600 AS bucket, {ROLL} FROM samples GROUP BY 1, 2")
def rollup_merge(spark, sf_dir):
    """Hours merged from minutes are the hours of the raw samples."""
    return _rolled(rollup.merge(rollup.rollup(bind.samples(spark, sf_dir), 60, "event_id"), 3600))


@query("rollup_backfill", f"WITH {SAMPLES_SQL} SELECT series_key, ts_ms // 3600000 * 3600 AS bucket, {ROLL} FROM samples WHERE ts_ms < 1705276800000 GROUP BY 1, 2")
def rollup_backfill(spark, sf_dir):
    return _rolled(rollup.backfill(bind.samples(spark, sf_dir), 3600, 1705278000, "event_id"))


@query("rollup_described", f"WITH {COUNTERS_SQL} SELECT series_key, ts_ms // 3600000 * 3600 AS bucket, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max_by(value, ts_ms), 6) AS last, count(*) AS cnt, 'seen at ' || max(event_id) AS metric_description, max_by(CASE WHEN ts_ms % 2 = 0 THEN 'ms' ELSE 's' END, ts_ms) AS metric_unit FROM samples GROUP BY 1, 2")
def rollup_described(spark, sf_dir):
    """Counters, with the last description and unit of an hour, merged from minutes."""
    rows = bind.counters(spark, sf_dir).withColumns({"metric_description": F.concat(F.lit("seen at "), F.col("event_id").cast("string")), "metric_unit": F.when(F.col("ts_ms") % 2 == 0, "ms").otherwise("s")})
    out = rollup.finished(rollup.merge(rollup.rollup(rows, 60, "event_id"), 3600), counter=True)
    return out.withColumns({c: F.round(c, 6) for c in ("min", "max", "last")})


_AUTO = [("auto_query_gauge", "app.value", bind.samples, SAMPLES_SQL, f"{INSTANT_SQL}, r AS (SELECT service_name, k, value FROM inst)"), ("auto_query_counter", "app_total", bind.counters, COUNTERS_SQL, f"{WINDOWS_SQL.replace(str(RANGE), '3600000')}, r AS (SELECT split_part(split_part(series_key, 'service_name\":\"', 2), '\"', 1) AS service_name, k, sum({INC}) / ((max(ts_ms) - min(ts_ms)) / 1000.0) AS value FROM w GROUP BY series_key, k HAVING count(*) >= 2 AND max(ts_ms) > min(ts_ms))")]


def _auto(metric, source):
    def run(spark, sf_dir):
        rows = source(spark, sf_dir)
        named = rows.withColumn("labels", F.map_concat(F.map_filter("labels", lambda k, v: k != "__name__"), F.create_map(F.lit("__name__"), F.lit(metric))))
        return _shown(rules.auto_series(named, metric, GRID, ["service_name"], 3_600_000))

    return run


for _name, _metric, _source, _rows, _with in _AUTO:
    QUERIES[_name] = _auto(_metric, _source)
    ORACLES[_name] = f"""WITH {_rows}, {_with} SELECT '{{"service_name":"' || service_name || '"}}' AS series_key, k, round(sum(value), 6) + 0.0 AS value FROM r GROUP BY service_name, k"""


_HALF = STEP // 2


@query(
    "expression",
    f"""WITH {SAMPLES_SQL}, {STEPS_SQL}, a AS (SELECT service_name, k, sum(value) AS v FROM samples JOIN steps ON ts_ms + 86400000 BETWEEN t - {RANGE} AND t GROUP BY 1, 2), b AS (SELECT service_name, k, sum(value) AS v FROM samples JOIN steps ON ts_ms BETWEEN t - {3 * RANGE} AND t WHERE shard = '1' GROUP BY 1, 2)
    SELECT '{{"service_name":"' || service_name || '"}}' AS series_key, k, round(abs(a.v / b.v - b.v), 6) AS value FROM a JOIN b USING (service_name, k)""",
)
def expression(spark, sf_dir):
    """A range a day ago, related to a longer one of a single shard, which occurs twice and is computed once."""
    sums = lambda m: expressions.Aggregate("sum", m.over("sum_over_time"), by=("service_name",))
    ago, now = sums(expressions.Metric("app.value", (), RANGE, 86_400_000)), sums(expressions.Metric("app.value", (("shard", "1"),), 3 * RANGE))
    return _shown(expressions.evaluate(expressions.Apply("abs", ago / now - now), bind.samples(spark, sf_dir), GRID))
