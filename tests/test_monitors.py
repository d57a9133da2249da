from pyspark.sql import functions as F

from tidewatch.operators import monitors, rules
from tidewatch.plans import monitors as plans
from tidewatch.sources import bind


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]

def test_every_rule_is_evaluated_as_it_would_be_alone(spark, sf_dir):
    table = plans.rule_rows(spark, 240).cache()
    many = {(r.rule_id, r.grp): r.value for r in plans._many_values(spark, sf_dir, table).collect()}
    samples = bind.samples(spark, sf_dir).cache()
    seen = 0
    for r in table.where("signal = 'metric'").collect()[::13]:
        rows = samples.where((F.unix_seconds("ts") >= plans.NOW - r.window_s) & (F.unix_seconds("ts") < plans.NOW))
        if r.service:
            rows = rows.where(F.col("service_name") == r.service)
        for k, v in (r.matchers or {}).items():
            rows = rows.where(F.col("labels")[k] == v)
        for k, v in (r.excluded or {}).items():
            rows = rows.where(F.col("labels")[k] != v)
        for k, v in (r.patterns or {}).items():
            rows = rows.where(F.col("labels")[k].rlike(v))
        alone = {x.grp: round(x.value, 6) for x in rules.metric_values(rows, r.aggregation, [F.col("labels")[k] for k in r.group_by or []]).collect()}
        assert alone == {g: v for (i, g), v in many.items() if i == r.rule_id}
        seen += len(alone)
    assert seen > 20

def test_each_table_is_read_once_for_all_rules(spark, tmp_path, sf_dir):
    for name, df in (("spans", bind.spans(spark, sf_dir)), ("samples", bind.samples(spark, sf_dir)), ("logs", bind.logs(spark, sf_dir))):
        df.drop("event_attributes").write.parquet(f"{tmp_path}/{name}")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    table = spark.createDataFrame(plans.rule_rows(spark, 240).collect(), monitors.RULES)  # a table, of which the planner knows no constants
    values = monitors.metric_values(table, monitors.metric_partials(read("samples"), 3600), plans.NOW)
    spans = monitors.span_values(table, monitors.span_partials(read("spans"), 3600), plans.NOW)
    for df in (values, spans, monitors.log_values(table, monitors.log_partials(read("logs"), 3600), plans.NOW)):
        text = plan(df)
        assert text.count("Scan parquet") == 1 and "NestedLoop" not in text and "HashJoin" in text
    goals = spark.createDataFrame([(f"o{i}", "view", float(i), 86400) for i in range(200)], "slo_id string, service string, threshold_ms double, window_s long")
    assert plan(monitors.objective_counts(goals, read("spans"), plans.NOW)).count("Scan parquet") == 1

def test_percentiles_of_rules_are_near_the_exact_ones(spark, sf_dir):
    spans = bind.spans(spark, sf_dir)
    kinds = [(f"{m}-{s}", "spans", m, s, 30 * 86400) for m in monitors.APM_METRICS for s in plans.SERVICES]
    table = spark.createDataFrame(kinds, "rule_id string, signal string, metric string, service string, window_s long")
    table = table.withColumns({c: F.lit(None).cast("map<string,string>") for c in ("matchers", "excluded", "patterns")}).withColumn("group_by", F.lit(None).cast("array<string>"))
    got = {r.rule_id: r.value for r in monitors.span_values(table, monitors.span_partials(spans, 3600), 1706572800 + 86400).collect()}
    values = {}
    for r in spans.select("service_name", (F.col("duration_ns") / 1e6).alias("ms")).collect():
        values.setdefault(r.service_name, []).append(r.ms)
    for s, v in values.items():
        v.sort()
        for m in (50, 75, 90, 95, 99):
            at, off = len(v) * m / 100, max(1, 0.01 * len(v)) + 1
            assert v[max(int(at - off), 0)] <= got[f"p{m}-{s}"] <= v[min(int(at + off), len(v) - 1)]

def test_rules_without_rows_and_empty_tables(spark, sf_dir):
    table = plans.rule_rows(spark, 9)
    none = monitors.metric_values(table, monitors.metric_partials(bind.samples(spark, sf_dir).limit(0)), plans.NOW)
    states = {r.rule_id: r.new_state for r in monitors.evaluate(table, none).collect()}
    assert len(states) == 9 and set(states.values()) == {"ok", "no_data"}
    assert monitors.evaluate(table.limit(0), none).count() == 0 and monitors.fired(table, none).count() == 0
    old = spark.createDataFrame([("r0", "x", "alert"), ("gone", "y", "alert")], "rule_id string, grp string, state string")
    assert {(r.rule_id, r.grp, r.new_state) for r in monitors.evaluate(table.where("rule_id = 'r0'"), none, old).collect()} == {("r0", "x", "ok")}
    goals = spark.createDataFrame([("o", "nobody", None, 60), ("p", "nobody", 5.0, 60)], "slo_id string, service string, threshold_ms double, window_s long")
    assert {tuple(r) for r in monitors.objective_counts(goals, bind.spans(spark, sf_dir), plans.NOW).collect()} == {("o", 0, 0), ("p", 0, 0)}
