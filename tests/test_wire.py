import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import explore
from tidewatch.operators import normalize as nz
from tidewatch.plans import wire
from tidewatch.sources import tables


def text_of(spark, value):
    row = spark.createDataFrame([(f'[{{"key":"k","value":{value}}}]',)], "v string")
    return row.select(nz.attributes(F.from_json("v", nz.ATTRS)).alias("a")).first().a["k"]


def test_nested_values_are_never_lost(spark):
    assert text_of(spark, '{"arrayValue":{"values":[{"arrayValue":{"values":[{"intValue":1}]}},{"stringValue":"x"}]}}') == "[[1],x]"
    assert text_of(spark, '{"kvlistValue":{"values":[{"key":"q","value":{"kvlistValue":{"values":[{"key":"z","value":{"stringValue":"deep"}}]}}},{"key":"none"}]}}') == "{q={z=deep},none=}"
    assert text_of(spark, '{"arrayValue":{"values":[{"boolValue":true},{"doubleValue":1.5},{}]}}') == "[true,1.5,]"
    assert text_of(spark, '{"arrayValue":{}}') == "[]" and text_of(spark, '{"kvlistValue":{"values":[]}}') == "{}" and text_of(spark, "{}") == ""
    deep = '{"stringValue":"end"}'
    for level in range(6):
        deep = f'{{"arrayValue":{{"values":[{deep}]}}}}'
        got = text_of(spark, deep)
        assert got == "[" * (level + 1) + "end" + "]" * (level + 1) if level < nz.DEPTH else got.startswith("[" * nz.DEPTH) and "end" in got


def test_status_words(spark):
    words = ["trace", "DEBUG", "notice", "warning", "err", "critical", "emergency", "alert", "odd", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    text, number = nz.severity(F.col("w"))
    got = [(r.t, r.n) for r in df.select(text.alias("t"), number.alias("n")).collect()]
    assert got == [("DEBUG", 5), ("DEBUG", 5), ("INFO", 9), ("WARN", 13), ("ERROR", 17), ("FATAL", 21), ("FATAL", 21), ("FATAL", 21), ("INFO", 9), ("INFO", 9)]


def chain(name, labels, rules):
    """The rules one after the other; None where the sample is blocked."""
    fits = lambda pattern, regex, value: not pattern or (re.search(pattern, value) is not None if regex else pattern == value)

    def applies(r, labels):
        if not fits(r.get("metric"), r.get("metric_regex"), name):
            return False
        key = r.get("label_key")
        return not key or (key in labels and fits(r.get("label_value"), r.get("label_regex"), labels[key]))

    active = [r for r in rules if r.get("enabled", True)]
    allow = [r for r in active if r["action"] == "allow" and (r.get("metric") or r.get("label_key"))]
    if not any(applies(r, labels) for r in allow) and any(applies(r, labels) for r in active if r["action"] not in ("allow", "drop_label")):
        return None
    for r in active:
        if r["action"] == "drop_label" and r.get("drop") and applies(r, labels):
            labels = {k: v for k, v in labels.items() if not fits(r["drop"], r.get("drop_regex"), k)}
    return labels


def test_indexed_rules_equal_the_chain_of_rules(spark):
    draw = random.Random(6)
    names, keys, values = [f"m{i}" for i in range(9)], ["a", "b", "ab"], ["x", "y", "xy"]
    rules = []
    for _ in range(60):
        r = {"action": draw.choice(("allow", "block", "drop_label", "drop_label", "odd"))}
        if draw.random() < 0.7:
            r |= {"metric": draw.choice([*names, "m[12]", "3$"])}
            r["metric_regex"] = r["metric"] not in names
        if draw.random() < 0.8:
            r |= {"label_key": draw.choice(keys), "label_value": draw.choice([*values, "", "^x"])}
            r["label_regex"] = r["label_value"] == "^x"
        if r["action"] == "drop_label":
            r |= {"drop": draw.choice([*keys, "^a"])}
            r["drop_regex"] = r["drop"] == "^a"
        if r["action"] == "block" and not r.get("label_key") and not r.get("metric"):
            continue
        rules.append(r | {"enabled": draw.random() < 0.9})
    rows = [(i, draw.choice(names), {k: draw.choice(values) for k in keys if draw.random() < 0.7}) for i in range(400)]
    out = nz.firewall(spark.createDataFrame(rows, "i int, metric_name string, attributes map<string,string>"), rules)
    assert out.columns == ["i", "metric_name", "attributes"]
    want = {i: held for i, name, labels in rows if (held := chain(name, labels, rules)) is not None}
    assert {r.i: r.attributes for r in out.collect()} == want and 0 < len(want) < 400
    assert nz.firewall(spark.createDataFrame(rows, "i int, metric_name string, attributes map<string,string>"), []).count() == 400


def test_the_plan_does_not_grow_with_the_rules(spark):
    samples = spark.createDataFrame([("m1", {"a": "x"})], "metric_name string, attributes map<string,string>")
    size = lambda n: len(nz.firewall(samples, [{"action": ("allow", "block", "drop_label")[i % 3], "metric": f"m{i}", "drop": "a"} for i in range(n)])._jdf.queryExecution().optimizedPlan().toString())
    assert size(5000) < size(6) * 1.5


def test_pages_and_exports_refuse_what_they_would_cut(spark, tmp_path):
    df = spark.range(30).selectExpr("id AS ts_ns", "CAST(id AS STRING) AS span_id")
    assert [r.ts_ns for r in explore.newest(df, 2, 3).collect()] == [26, 25]
    for call in (lambda: explore.newest(df, 10, 50_001), lambda: explore.newest(df, 1001), lambda: explore.keyset_page(df, 1001), lambda: explore.log_page(df, 10, 50_001), lambda: tables.export_json(df, str(tmp_path / "x"), 2_000_000)):
        with pytest.raises(ValueError):
            call()
    for rows, cut in ((10, True), (30, False), (31, False)):
        path = str(tmp_path / f"e{rows}")
        tables.export_csv(df, path, max_rows=rows, note={"query": "all"})
        side = spark.read.json(path + "_query").first()
        assert (side.query, side.rows, side.truncated) == ("all", min(rows, 30), cut)
        assert spark.read.option("header", True).csv(path).count() == min(rows, 30)


def test_no_metric_record_grows_with_the_events(spark, sf_dir):
    metrics = wire._metric_records(spark, sf_dir).select(F.explode("resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    kinds = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
    found = metrics.agg(*(F.struct(F.max(F.size(f"m.{k}.dataPoints")).alias("most"), F.sum(F.size(f"m.{k}.dataPoints")).alias("points")).alias(k) for k in kinds)).first()
    assert [found[k].most for k in ("gauge", "sum")] == [1, 1] and found.histogram.most <= 24
    assert found.exponentialHistogram.most <= 31 and found.summary.most <= 31
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert found.gauge.points == found["sum"].points == events


def test_metric_texts_are_parsed_once(spark, sf_dir):
    plan = wire._metric_table(spark, sf_dir, "metrics_sum")._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan and not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "from_json" in line]
    none = spark.createDataFrame([(None,), ([],)], nz.METRIC_RECORDS)
    assert [table.count() for table in nz.metrics(none, "t").values()] == [0] * 5
