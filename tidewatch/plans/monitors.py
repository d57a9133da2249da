"""Queries of many monitors and objectives at once, and of stored sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.core import is_error, materialize, milliseconds
from tidewatch.operators import monitors, rules, rum, services, sketches
from tidewatch.sources import bind
from tidewatch.sources.bind import LOGS_SQL, RUM_SQL, SAMPLES_SQL, SPANS_SQL

QUERIES, ORACLES = {}, {}
NOW = 1705708800
SERVICES = ("click", "error", "purchase", "signup", "view")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------------------------ many rules


def rule_rows(spark, n: int = 240) -> DataFrame:
    """Rules on metrics, spans and logs in turn, of all kinds."""
    i = F.col("id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    part, text = F.floor(i / 3), lambda c: c.cast("string")
    kind = i % 3
    pair = lambda k, v: F.create_map(F.lit(k), v)
    return spark.range(n).select(
        F.concat(F.lit("r"), text(i)).alias("rule_id"), pick(("metric", "spans", "logs"), i).alias("signal"),
        F.when(kind == 0, "app.value").when(kind == 1, pick(("error_rate", "error_count", "request_rate"), F.floor(i / 15))).alias("metric"),
        F.when((kind == 0) & (part % 2 == 0), pick(SERVICES, part)).when((kind == 1) & (part % 4 > 0), pick(SERVICES, part)).when(kind == 2, F.concat(F.lit("src"), text(i % 20))).alias("service"),
        F.when((kind == 0) & (i % 4 == 1), pair("shard", text(i % 5))).when(kind == 2, pair("severity_text", pick(("ERROR", "FATAL", "WARN", "INFO"), i))).alias("matchers"),
        F.when((kind == 0) & (i % 4 == 2), pair("service_name", F.lit("view"))).alias("excluded"), F.when((kind == 0) & (i % 4 == 3), pair("shard", F.lit("^[1-3]$"))).alias("patterns"),
        pick(("avg", "sum", "min", "max", "count"), part).alias("aggregation"), F.when(i % 2 == 0, F.array(F.lit("service_name"))).when(kind == 0, F.array(F.lit("service_name"), F.lit("shard"))).alias("group_by"),
        F.when(kind == 2, 20 * 86400).otherwise(86400 * (i % 7 + 1)).cast("bigint").alias("window_s"),
        (i % 90 + 20.5).alias("critical"), F.lit(None).cast("double").alias("critical_recovery"), (i % 90 + 0.25).alias("warning"), F.lit(None).cast("double").alias("warning_recovery"),
        F.when(i % 7 == 0, "below").otherwise("above").alias("comparator"), F.when(i % 2 == 0, "resolve").otherwise("notify").alias("no_data_action"),
    )


_SVC = "['click', 'error', 'purchase', 'signup', 'view']"
RULES_SQL = f"""r AS (SELECT i, 'r' || i AS rule_id, i % 3 AS sort_, i // 3 AS part, {_SVC}[i // 3 % 5 + 1] AS svc, CASE WHEN i % 3 = 2 THEN 20 * 86400 ELSE 86400 * (i % 7 + 1) END AS window_s,
    ['avg', 'sum', 'min', 'max', 'count'][i // 3 % 5 + 1] AS aggregation, i % 90 + 20.5 AS critical, i % 90 + 0.25 AS warning FROM range(240) t(i))"""
_AGO = f"epoch_us(ts) // 1000000 >= {NOW} - window_s AND epoch_us(ts) // 1000000 < {NOW}"
VALUES_SQL = f"""{RULES_SQL}, mv AS (
  SELECT rule_id, CASE WHEN i % 2 = 0 THEN service_name ELSE service_name || ':' || shard END AS grp,
    CASE aggregation WHEN 'avg' THEN avg(value) WHEN 'sum' THEN sum(value) WHEN 'min' THEN min(value) WHEN 'max' THEN max(value) ELSE count(*) END AS value
  FROM r JOIN samples ON {_AGO} AND (part % 2 = 1 OR service_name = svc) AND CASE i % 4 WHEN 1 THEN shard = CAST(i % 5 AS VARCHAR) WHEN 2 THEN service_name <> 'view' WHEN 3 THEN shard IN ('1', '2', '3') ELSE TRUE END
  WHERE sort_ = 0 GROUP BY rule_id, 2, aggregation
), sv AS (
  SELECT rule_id, CASE WHEN i % 2 = 0 THEN service_name ELSE '' END AS grp,
    CASE i // 15 % 3 WHEN 0 THEN count(*) FILTER (is_error) * 100.0 / count(*) WHEN 1 THEN count(*) FILTER (is_error) ELSE count(*) / CAST(window_s AS DOUBLE) END AS value
  FROM r JOIN spans ON {_AGO} AND (part % 4 = 0 OR service_name = svc) WHERE sort_ = 1 GROUP BY rule_id, i, 2, window_s
), lv AS (
  SELECT rule_id, CASE WHEN i % 2 = 0 THEN service_name ELSE '' END AS grp, CAST(count(*) AS DOUBLE) AS value
  FROM r JOIN logs ON ts_s >= {NOW} - window_s AND ts_s < {NOW} AND service_name = 'src' || i % 20 AND severity_text = ['ERROR', 'FATAL', 'WARN', 'INFO'][i % 4 + 1] WHERE sort_ = 2 GROUP BY rule_id, 2
), vals AS (SELECT * FROM mv UNION ALL SELECT * FROM sv UNION ALL SELECT * FROM lv)"""


def _many_values(spark, sf_dir, rules):
    metric = monitors.metric_values(rules, monitors.metric_partials(bind.samples(spark, sf_dir), 3600), NOW)
    spans = monitors.span_values(rules, monitors.span_partials(bind.spans(spark, sf_dir), 3600), NOW)
    logs = monitors.log_values(rules, monitors.log_partials(bind.logs(spark, sf_dir), 3600), NOW)
    return reduce(DataFrame.unionByName, (metric, spans, logs)).withColumn("value", F.round("value", 6))


@query(
    "monitors_many",
    f"""WITH {SPANS_SQL}, {SAMPLES_SQL}, {LOGS_SQL}, {VALUES_SQL} SELECT r.rule_id, coalesce(grp, '') AS grp, round(value, 6) AS value,
    CASE WHEN value IS NULL THEN CASE WHEN i % 2 = 0 THEN 'ok' ELSE 'no_data' END WHEN i % 7 = 0 THEN CASE WHEN value < critical THEN 'alert' WHEN value < warning THEN 'warn' ELSE 'ok' END WHEN value >= critical THEN 'alert' WHEN value >= warning THEN 'warn' ELSE 'ok' END AS new_state
    FROM r LEFT JOIN vals USING (rule_id)""",
)
def monitors_many(spark, sf_dir):
    """240 rules in one evaluation."""
    rules = rule_rows(spark)
    return monitors.evaluate(rules, _many_values(spark, sf_dir, rules)).select("rule_id", "grp", "value", "new_state")


@query("detect_many", f"WITH {SPANS_SQL}, {SAMPLES_SQL}, {LOGS_SQL}, {VALUES_SQL} SELECT rule_id, count(*) AS matches FROM r JOIN vals USING (rule_id) WHERE CASE WHEN i % 7 = 0 THEN value < critical ELSE value >= critical END GROUP BY 1")
def detect_many(spark, sf_dir):
    rules = rule_rows(spark)
    return monitors.fired(rules, _many_values(spark, sf_dir, rules))


@query(
    "objectives_many",
    f"""WITH {SPANS_SQL}, o AS (SELECT 'o' || i AS slo_id, {_SVC}[i % 5 + 1] AS service, CASE WHEN i % 3 > 0 THEN 5.0 * (i % 40) END AS threshold_ms, 86400 * (i % 9 + 1) AS window_s FROM range(200) t(i))
    SELECT slo_id, count(*) FILTER (CASE WHEN threshold_ms IS NULL THEN is_error ELSE duration_ns / 1e6 > threshold_ms END) AS bad, count(service_name) AS total
    FROM o LEFT JOIN spans ON service_name = service AND epoch_us(ts) // 1000000 >= {NOW} - window_s AND epoch_us(ts) // 1000000 < {NOW} GROUP BY 1""",
)
def objectives_many(spark, sf_dir):
    """200 objectives of availability and latency, from one scan."""
    i = F.col("id")
    service = F.element_at(F.array(*map(F.lit, SERVICES)), (i % 5 + 1).cast("int"))
    table = spark.range(200).select(F.concat(F.lit("o"), i.cast("string")).alias("slo_id"), service.alias("service"), F.when(i % 3 > 0, (i % 40) * 5.0).alias("threshold_ms"), (86400 * (i % 9 + 1)).alias("window_s"))
    return monitors.objective_counts(table, bind.spans(spark, sf_dir), NOW)


# ------------------------------------------------------- estimated percentiles


@query(
    "estimated_percentiles",
    f"""WITH {SPANS_SQL}, {RUM_SQL.replace("e AS", "r0 AS").replace("FROM e)", "FROM r0)")} SELECT 'red' AS kind, service_name AS grp, TRUE AS close FROM spans GROUP BY 2 UNION ALL SELECT 'apm', service_name, TRUE FROM spans GROUP BY 2
    UNION ALL SELECT 'operation', span_name, TRUE FROM spans WHERE service_name = 'view' AND kind = 'SPAN_KIND_SERVER' GROUP BY 2
    UNION ALL SELECT 'vital', vital_name, TRUE FROM rum WHERE vital_name IS NOT NULL GROUP BY 2 UNION ALL SELECT 'all', '', TRUE""",
)
def estimated_percentiles(spark, sf_dir):
    """What the operators estimate by default lies between the exact percentiles of ranks one hundredth off."""
    spans, vitals = bind.spans(spark, sf_dir), bind.rum(spark, sf_dir)
    server = spans.where("service_name = 'view' AND kind = 'SPAN_KIND_SERVER'")
    kinds = {
        "red": (services.service_nodes(spans).select(F.col("service_name").alias("grp"), F.array("p50_ms", "p95_ms", "p99_ms").alias("got")), spans, F.col("service_name"), milliseconds(), (0.5, 0.95, 0.99)),
        "apm": (rules.apm_values(spans, "p90", 60).select("grp", F.array("value").alias("got")), spans, F.col("service_name"), milliseconds(), (0.9,)),
        "operation": (rules.latency_regression({"spans": spans}, "2000-01-01", "2100-01-01", p99_ms=0, least=0).where("service_name = 'view'").select(F.col("span_name").alias("grp"), F.array("p99_ms").alias("got")), server, F.col("span_name"), milliseconds(), (0.99,)),
        "vital": (rum.vitals(vitals).select(F.col("vital_name").alias("grp"), F.array("p75").alias("got")), vitals.where("vital_name IS NOT NULL"), F.col("vital_name"), F.col("vital_value"), (0.75,)),
        "all": (services.latency_percentiles(spans).select(F.lit("").alias("grp"), F.array("p50_ms", "p95_ms", "p99_ms").alias("got")), spans, F.lit(""), milliseconds(), (0.5, 0.95, 0.99)),
    }

    def close(kind: str) -> DataFrame:
        found, rows, key, value, marks = kinds[kind]
        edge = lambda off: F.percentile(value, F.array(*(F.lit(min(max(m + off, 0.0), 1.0)) for m in marks)))
        exact = rows.groupBy(key.alias("grp")).agg(F.count("*").alias("n"), edge(-0.01).alias("low"), edge(0.01).alias("high"), F.sort_array(F.collect_set(value)).alias("values"))
        # a group of few values allows for the value next to the rank
        near = lambda x, low, high: (F.array_position("values", x) > 0) & (x >= F.element_at("values", F.greatest(F.size(F.filter("values", lambda v: v < low)), F.lit(1)))) & (x <= F.element_at("values", F.least(F.size(F.filter("values", lambda v: v <= high)) + 1, F.size("values"))))
        every = F.forall(F.arrays_zip("got", "low", "high"), lambda m: near(m["got"], m["low"], m["high"]))
        return found.join(exact, "grp").select(F.lit(kind).alias("kind"), "grp", every.alias("close"))

    return reduce(DataFrame.unionByName, map(close, kinds))


# -------------------------------------------------------------- stored sketches

_DAY = "epoch_us(ts) // 86400000000 * 86400"
#: Largest error of a rank that the rows allow for, and of a number of distinct values.
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.04


def _within(df, exact, keys, marks):
    """Whether each estimate lies between the exact values of the ranks just below and above."""
    both = df.join(exact, keys)
    return both.select(*keys, "cnt", *(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")).alias(f"{m}_close") for m in marks))


_MARKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("rollup_quantiles", f"WITH {SPANS_SQL} SELECT service_name, {_DAY} AS bucket, count(*) AS cnt, TRUE AS p50_close, TRUE AS p95_close, TRUE AS p99_close FROM spans GROUP BY 1, 2")
def rollup_quantiles(spark, sf_dir):
    """Percentiles of days from stored sketches of minutes, held against the exact values at ranks one hundredth off."""
    spans = bind.spans(spark, sf_dir)
    minutes = materialize(sketches.quantile_partials(spans, ["service_name"], milliseconds(), 60), "quantiles")
    days = sketches.merge_quantiles(minutes, ["service_name"], 86400)
    found = days.select("service_name", "bucket", "cnt", *(sketches.quantile("sketch", r).alias(m) for m, r in _MARKS.items()))
    day = (F.floor(F.unix_seconds("ts") / 86400) * 86400).cast("bigint")
    # the ranks of a value step by one row, so a small day allows for one row either way
    values = spans.groupBy("service_name", day.alias("bucket")).agg(F.sort_array(F.collect_list(milliseconds())).alias("v"))
    at = lambda rank: F.element_at("v", F.greatest(F.least(rank, F.size("v")), F.lit(1)).cast("int"))
    off = F.greatest(F.size("v") * RANK_ERROR, F.lit(1))
    exact = values.select("service_name", "bucket", *(at(F.floor(F.size("v") * r - off)).alias(f"{m}_low") for m, r in _MARKS.items()), *(at(F.ceil(F.size("v") * r + off)).alias(f"{m}_high") for m, r in _MARKS.items()))
    return _within(found, exact, ["service_name", "bucket"], _MARKS)


@query("window_quantiles", f"WITH {SAMPLES_SQL}, g AS (SELECT 1704153600 + 43200 * unnest(range(0, 56)) AS step) SELECT service_name, step AS \"at\", count(*) AS cnt, TRUE AS close FROM g JOIN samples ON ts_ms // 3600000 * 3600 >= step - 86400 AND ts_ms // 3600000 * 3600 < step GROUP BY 1, 2")
def window_quantiles(spark, sf_dir):
    """Percentiles of sliding days from stored sketches of hours, held against exact ones at ranks one hundredth off."""
    rows = bind.samples(spark, sf_dir)
    hours = materialize(sketches.quantile_partials(rows, ["service_name"], F.col("value"), 3600), "hours")
    found = sketches.window_quantiles(hours, ["service_name"], 0.9, 1704153600, 1704153600 + 43200 * 55, 43200, 86400)
    at = F.col("hour") - F.pmod(F.col("hour") - 1704153600, F.lit(43200))
    moved = rows.withColumn("hour", (F.floor(F.col("ts_ms") / 3_600_000) * 3600).cast("bigint")).select("service_name", "value", F.explode(F.array(at + 43200, at + 86400)).alias("at"))
    exact = moved.groupBy("service_name", "at").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("value")).alias("v"))
    off = F.greatest(F.col("n") * RANK_ERROR, F.lit(1))
    place = lambda rank: F.element_at("v", F.greatest(F.least(rank, F.size("v")), F.lit(1)).cast("int"))
    close = F.col("value").between(place(F.floor(F.col("n") * 0.9 - off)), place(F.ceil(F.col("n") * 0.9 + off)))
    return found.join(exact, ["service_name", "at"]).select("service_name", "at", "cnt", close.alias("close"))


def _close(a, b):
    return F.abs(a - b) <= F.greatest(b * DISTINCT_ERROR, F.lit(1))


@query("rollup_uniques", f"WITH {SPANS_SQL} SELECT service_name, {_DAY} // 604800 * 604800 AS week, TRUE AS close, TRUE AS close_hll FROM spans GROUP BY 1, 2")
def rollup_uniques(spark, sf_dir):
    """Distinct traces of weeks from stored sketches of hours, of both kinds."""
    spans = bind.spans(spark, sf_dir)
    keys, week = ["service_name", "week"], (F.floor(F.col("bucket") / 604800) * 604800).cast("bigint")
    hours = materialize(sketches.distinct_partials(spans, ["service_name"], "trace_id", 3600), "distinct")
    small = materialize(sketches.unique_partials(spans, ["service_name"], "trace_id", 3600), "distinct-hll")
    found = sketches.range_distinct(hours.withColumn("week", week), keys).join(sketches.range_unique(small.withColumn("week", week), keys).withColumnRenamed("distinct_values", "hll"), keys)
    exact = spans.select("service_name", (F.floor(F.floor(F.unix_seconds("ts") / 86400) * 86400 / 604800) * 604800).cast("bigint").alias("week"), "trace_id").groupBy(*keys).agg(F.countDistinct("trace_id").alias("n"))
    return found.join(exact, keys).select(*keys, _close(F.col("distinct_values"), F.col("n")).alias("close"), _close(F.col("hll"), F.col("n")).alias("close_hll"))


@query("sketch_funnel", "SELECT * FROM (VALUES (1, TRUE), (2, TRUE), (3, TRUE)) t(step, close)")
def sketch_funnel(spark, sf_dir):
    """Traces that hold each kind of span, and all kinds before it, from stored sketches of hours."""
    spans = bind.spans(spark, sf_dir)
    tests = [F.col("service_name") == "view", F.col("service_name") == "click", F.col("service_name") == "purchase"]
    hours = materialize(sketches.step_sketches(spans, [], "trace_id", tests, 3600), "steps")
    found = sketches.sketch_funnel(hours, [], 3)
    per_trace = spans.groupBy("trace_id").agg(*(F.bool_or(t).alias(f"s{i}") for i, t in enumerate(tests)))
    reached = [reduce(lambda a, b: a & b, (F.col(f"s{j}") for j in range(i + 1))) for i in range(3)]
    exact = per_trace.agg(*(F.count_if(r).alias(f"n{i}") for i, r in enumerate(reached))).select(F.inline(F.array(*(F.struct(F.lit(i + 1).alias("step"), F.col(f"n{i}").alias("n")) for i in range(3)))))
    # the error of an intersection is that of the sets it is taken from
    total = per_trace.agg(F.count("*").alias("total"))
    return found.join(exact, "step").join(F.broadcast(total)).select("step", (F.abs(F.col("reached") - F.col("n")) <= F.greatest(F.col("total") * DISTINCT_ERROR, F.lit(1))).alias("close"))


@query("fresh_series", f"WITH {SAMPLES_SQL}, d AS (SELECT service_name, series_key, min(ts) AS first_ts, max(ts) >= TIMESTAMP '2024-01-15' AS now FROM samples GROUP BY 1, 2) SELECT service_name, count(*) FILTER (now) AS distinct_values, count(*) FILTER (first_ts >= TIMESTAMP '2024-01-15') AS fresh FROM d GROUP BY 1")
def fresh_series(spark, sf_dir):
    """Series since a day, and those that had not been there before: exact, since so few values fill no sketch."""
    days = sketches.distinct_partials(bind.samples(spark, sf_dir), ["service_name"], "series_key", 86400)
    return sketches.fresh_values(days, ["service_name"], 1705276800, 2**40)
