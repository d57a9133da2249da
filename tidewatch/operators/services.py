"""Services and traces: graph, endpoints, errors, funnels, trace trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.core import is_error, milliseconds, percentiles, shared_folder
from tidewatch.operators.explore import _spread, red

SERVER = "SPAN_KIND_SERVER"


def service_nodes(spans: DataFrame, approx: bool = True) -> DataFrame:
    """Rate, errors and durations of each service."""
    return _spread(spans.groupBy("service_name").agg(*red("status_or_http", approx)))


def service_edges(spans: DataFrame) -> DataFrame:
    """(parent, child, calls, errors, avg_ms): calls from one service into another.

    Both sides of the self-join are dealt by (trace, span), one shuffle each; only
    the columns of the edge travel.
    """
    child = spans.where("parent_span_id <> ''").select("trace_id", F.col("parent_span_id").alias("span_id"), F.col("service_name").alias("child"), is_error().alias("failed"), "duration_ns")
    parent = spans.select("trace_id", "span_id", F.col("service_name").alias("parent"))
    joined = child.join(parent, ["trace_id", "span_id"]).where("parent <> child")
    return joined.groupBy("parent", "child").agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.avg(milliseconds()).alias("avg_ms"))


def latency_histogram(spans: DataFrame) -> DataFrame:
    """(power, total): spans by the power of two of their milliseconds."""
    power = F.floor(F.log2(F.greatest(milliseconds(), F.lit(0.001)))).cast("int")
    return spans.groupBy(power.alias("power")).agg(F.count("*").alias("total"))


def latency_percentiles(spans: DataFrame, approx: bool = True) -> DataFrame:
    marks = spans.agg(percentiles(milliseconds(), 0.5, 0.95, 0.99, approx=approx).alias("_p"))
    return _spread(marks)


def endpoint_red(spans: DataFrame, service: str, approx: bool = True) -> DataFrame:
    """Server spans of a service by method and path."""
    return _spread(spans.where((F.col("service_name") == service) & (F.col("kind") == SERVER)).groupBy("http_method", "http_path").agg(*red("status_or_http", approx)))


def operation_red(spans: DataFrame, service: str, noise: tuple[str, ...] = (), approx: bool = True) -> DataFrame:
    """Spans of a service that no client asked for directly, by name; ``noise`` are LIKE patterns to leave out."""
    rows = spans.where((F.col("service_name") == service) & (F.col("kind") != SERVER))
    for pattern in noise:
        rows = rows.where(~F.col("span_name").like(pattern))
    return _spread(rows.groupBy("span_name").agg(*red("status_or_http", approx)))


def error_groups(spans: DataFrame, service: str, limit: int = 50) -> DataFrame:
    """Failing server spans by status, method and path."""
    failing = spans.where((F.col("service_name") == service) & (F.col("kind") == SERVER) & is_error())
    grouped = failing.groupBy("http_status_code", "http_method", "http_path").agg(F.count("*").alias("total"), F.max("ts_ns").alias("last_seen"))
    key = F.concat_ws(" ", F.col("http_status_code").cast("string"), "http_method", "http_path")
    return grouped.select(key.alias("key"), "total", "last_seen").orderBy(F.desc("total"), "key").limit(limit)


def message_template(body: str | Column) -> Column:
    """A message with its UUIDs and numbers replaced, so that variants group."""
    text = F.regexp_replace(body, "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "UUID")
    return F.regexp_replace(text, "[0-9]+", "N")


def error_templates(logs: DataFrame, service: str, limit: int = 50) -> DataFrame:
    """Messages of warnings and errors by template, with the worst severity and the last example."""
    rows = logs.where((F.col("service_name") == service) & F.col("severity_text").isin("ERROR", "WARN", "FATAL"))
    grouped = rows.groupBy(message_template("body").alias("key")).agg(
        F.max_by("severity_text", "severity_number").alias("severity"), F.max_by("body", F.struct("ts_ns", "span_id")).alias("example"), F.count("*").alias("total"), F.max("ts_ns").alias("last_seen")
    )
    return grouped.orderBy(F.desc("total"), "key").limit(limit)


def trace_summary(spans: DataFrame) -> DataFrame:
    """(trace_id, spans, services, duration_ns): services sorted, the longest span."""
    return spans.groupBy("trace_id").agg(F.count("*").alias("spans"), F.sort_array(F.collect_set("service_name")).alias("services"), F.max("duration_ns").alias("duration_ns"))


def trace_index(spans: DataFrame) -> DataFrame:
    """(trace_id, start_ns, end_ns): when each trace ran."""
    return spans.groupBy("trace_id").agg(F.min("ts_ns").alias("start_ns"), F.max(F.col("ts_ns") + F.col("duration_ns")).alias("end_ns"))


def trace_spans(spans: DataFrame, wanted: DataFrame, index: DataFrame, pad_ns: int = 300_000_000_000) -> DataFrame:
    """Spans of the ``wanted(trace_id)`` traces, looked for only around the time that the index gives.

    Of spans stored by ``date``, only the dates that any wanted trace touches are read: those
    dates, one for each day at most, are found first and become a filter of partitions.
    """
    bounds = index.join(wanted, "trace_id", "left_semi").select("trace_id", (F.col("start_ns") - pad_ns).alias("_low"), (F.col("end_ns") + pad_ns).alias("_high"))
    if "date" in spans.columns:
        day = lambda ns: F.to_date(F.timestamp_micros((F.col(ns) / 1000).cast("bigint")))
        days = [r[0] for r in bounds.select(F.explode(F.sequence(day("_low"), day("_high")))).distinct().collect()]
        spans = spans.where(F.col("date").isin(days))
    return spans.join(bounds, "trace_id").where(F.col("ts_ns").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def span_tree(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, path) of all traces at once.

    Roots have no parent (or zeros for one); ``path`` orders children by time; spans
    that no root reaches (orphans, cycles) are dropped. Each round doubles how far every
    span sees up, so a depth of 256 takes eight joins; rounds are cut by checkpoints.
    They end when no span is left waiting or none of those left can reach a root.
    """
    step = F.lpad(F.row_number().over(Window.partitionBy("trace_id", "parent_span_id").orderBy("ts_ns", "span_id")).cast("string"), 10, "0")
    up = F.when(F.col("parent_span_id").rlike("^0*$"), "").otherwise(F.col("parent_span_id"))
    seen = _cut(spans.select("trace_id", "span_id", up.alias("up"), F.when(up == "", 0).otherwise(1).alias("depth"), step.alias("path")))
    while not seen.where("up <> ''").isEmpty():
        done = seen.where("up = ''").count()
        above = seen.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("higher"), F.col("depth").alias("more"), F.col("path").alias("before"))
        further = seen.where("up <> ''").join(above, ["trace_id", "up"]).select("trace_id", "span_id", F.col("higher").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat_ws("/", "before", "path").alias("path"))
        seen = _cut(seen.where("up = ''").unionByName(further))
        # Spans within reach of a root end in each round, so a round in which none ends leaves only cycles and what hangs on orphans.
        if seen.where("up = ''").count() == done:
            break
    return seen.where("up = ''").drop("up")


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def funnel(spans: DataFrame, steps: list[tuple[str, Column]], ordered: bool = False) -> DataFrame:
    """(step, label, traces, pct_first, pct_previous, dropped): traces that match each step, in one pass.

    Steps count independently; ``ordered`` asks that a trace has matched all earlier
    steps, each no later than the next.
    """
    firsts = [F.min(F.when(test, F.col("ts_ns"))).alias(f"s{i}") for i, (_, test) in enumerate(steps)]
    per_trace = spans.groupBy("trace_id").agg(*firsts)
    reached, ok = [], F.lit(True)
    for i in range(len(steps)):
        here = F.col(f"s{i}").isNotNull()
        ok = ok & here & ((F.col(f"s{i}") >= F.col(f"s{i - 1}")) if i else F.lit(True))
        reached.append(ok if ordered else here)
    totals = per_trace.agg(*(F.count_if(r).alias(f"n{i}") for i, r in enumerate(reached)))
    rows = F.array(*(F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.col(f"n{i}").alias("traces"), F.col(f"n{max(i - 1, 0)}").alias("previous"), F.col("n0").alias("first")) for i, (label, _) in enumerate(steps)))
    pct = lambda n, of: F.round(F.when(F.col(of) > 0, F.col(n) * 100.0 / F.col(of)).otherwise(0.0), 2)
    return totals.select(F.inline(rows)).select("step", "label", "traces", pct("traces", "first").alias("pct_first"), pct("traces", "previous").alias("pct_previous"), F.greatest(F.col("previous") - F.col("traces"), F.lit(0)).alias("dropped"))


def service_catalog(spans: DataFrame) -> DataFrame:
    """(tenant_id, service_name, http_path, http_method, last_seen_ns, requests)."""
    return spans.groupBy("tenant_id", "service_name", "http_path", "http_method").agg(F.max("ts_ns").alias("last_seen_ns"), F.count("*").alias("requests"))
