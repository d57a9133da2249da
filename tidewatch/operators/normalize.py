"""Wire shapes of telemetry, decoded to JSON or rows, as jobs that give stored rows.

Every job is a function of DataFrames and runs alike on batches and streams.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.core import attr, non_empty

#: Levels of lists and pairs inside a typed value; what is deeper is kept as its JSON text.
DEPTH = 3
SCALAR = "stringValue:string,intValue:bigint,doubleValue:double,boolValue:boolean,bytesValue:binary"
#: A typed value. Lists and pairs are read as text, and parsed level by level where there are any.
ANY = f"struct<{SCALAR},arrayValue:string,kvlistValue:string>"
_INSIDE = f"values array<struct<key:string,value:{ANY},{SCALAR},arrayValue:string,kvlistValue:string>>"
_FIELDS = [f.split(":")[0] for f in f"{SCALAR},arrayValue,kvlistValue".split(",")]
ATTRS = f"array<struct<key:string,value:{ANY}>>"
RESOURCE = f"struct<attributes:{ATTRS}>"
SCOPE = f"struct<name:string,version:string,attributes:{ATTRS}>"
SPAN_RECORDS = (
    f"resourceSpans array<struct<resource:{RESOURCE},schemaUrl:string,scopeSpans:array<struct<scope:{SCOPE},schemaUrl:string,spans:array<struct<"
    f"traceId:string,spanId:string,parentSpanId:string,traceState:string,name:string,kind:int,startTimeUnixNano:bigint,endTimeUnixNano:bigint,attributes:{ATTRS},"
    f"status:struct<code:int,message:string>,events:array<struct<timeUnixNano:bigint,name:string,attributes:{ATTRS}>>,"
    f"links:array<struct<traceId:string,spanId:string,traceState:string,attributes:{ATTRS}>>>>>>>>"
)
LOG_RECORDS = (
    f"resourceLogs array<struct<resource:{RESOURCE},scopeLogs:array<struct<scope:{SCOPE},logRecords:array<struct<timeUnixNano:bigint,observedTimeUnixNano:bigint,"
    f"severityNumber:int,severityText:string,body:{ANY},attributes:{ATTRS},traceId:string,spanId:string,flags:int,eventName:string>>>>>>"
)
_POINT = f"attributes:{ATTRS},startTimeUnixNano:bigint,timeUnixNano:bigint,flags:int"
_EXEMPLAR = f"exemplars:array<struct<filteredAttributes:{ATTRS},timeUnixNano:bigint,asDouble:double,asInt:bigint,spanId:string,traceId:string>>"
_NUMBER = f"array<struct<{_POINT},asDouble:double,asInt:bigint,{_EXEMPLAR}>>"
METRIC_RECORDS = (
    f"resourceMetrics array<struct<resource:{RESOURCE},scopeMetrics:array<struct<scope:{SCOPE},metrics:array<struct<name:string,description:string,unit:string,"
    f"gauge:struct<dataPoints:{_NUMBER}>,sum:struct<dataPoints:{_NUMBER},aggregationTemporality:int,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:array<struct<{_POINT},count:bigint,sum:double,min:double,max:double,bucketCounts:array<bigint>,explicitBounds:array<double>,{_EXEMPLAR}>>,aggregationTemporality:int>,"
    f"exponentialHistogram:struct<dataPoints:array<struct<{_POINT},count:bigint,sum:double,min:double,max:double,scale:int,zeroCount:bigint,positive:struct<offset:int,bucketCounts:array<bigint>>,negative:struct<offset:int,bucketCounts:array<bigint>>,{_EXEMPLAR}>>,aggregationTemporality:int>,"
    f"summary:struct<dataPoints:array<struct<{_POINT},count:bigint,sum:double,quantileValues:array<struct<quantile:double,value:double>>>>>>>>>>>"
)
# Fixed names of span kinds and status codes, by number.
KINDS = ("SPAN_KIND_UNSPECIFIED", "SPAN_KIND_INTERNAL", "SPAN_KIND_SERVER", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER", "SPAN_KIND_CONSUMER")
STATUSES = ("STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR")


def _named(code: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code), F.lit(names[0]))


def span_kind(code: Column) -> Column:
    return _named(code, KINDS)


def status_code(code: Column) -> Column:
    return _named(code, STATUSES)


def _scalar(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"].cast("string"), v["doubleValue"].cast("string"), v["boolValue"].cast("string"), F.lower(F.hex(v["bytesValue"])), F.lit(""))


def any_value(v: Column, depth: int = DEPTH) -> Column:
    """A typed value as text: arrays as ``[a,b]``, pairs as ``{k=v}``, bytes in hex, and so on inside them."""
    text = F.coalesce(v["arrayValue"], v["kvlistValue"])
    if not depth:
        return F.coalesce(text, _scalar(v))

    def item(e: Column) -> Column:
        held = F.coalesce(e["value"], F.struct(*(e[f].alias(f) for f in _FIELDS)))  # a pair has a value, an item of a list is one
        name = F.when(v["kvlistValue"].isNotNull(), F.concat(F.coalesce(e["key"], F.lit("")), F.lit("="))).otherwise("")
        return F.concat(name, _let(held, lambda h: any_value(h, depth - 1)))

    inside = F.coalesce(F.array_join(F.transform(F.from_json(text, _INSIDE)["values"], item), ","), F.lit(""))
    left, right = (F.when(v["arrayValue"].isNotNull(), a).otherwise(b) for a, b in ("[{", "]}"))
    return F.when(text.isNull(), _scalar(v)).otherwise(F.concat(left, inside, right))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed, and its expression planned, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def attributes(list_: Column) -> Column:
    """Key-value lists as a map; of a repeated key the last value stays."""
    entries = F.coalesce(F.transform(list_, lambda e: F.struct(e["key"].alias("key"), any_value(e["value"]).alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))

    def by_key(pairs: Column) -> Column:
        # only a list with repeated keys, which map_from_entries would refuse, is searched for their last places
        keys = F.transform(pairs, lambda e: e["key"])
        last = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.reverse(pairs), F.array_position(F.reverse(keys), k).cast("int")))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).otherwise(last))

    return _let(entries, by_key)


def _times(ns: Column) -> dict[str, Column]:
    return {"ts_ns": ns, "ts": F.timestamp_micros(F.floor(ns / 1000).cast("bigint"))}


def _cols(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def _unpacked(records: DataFrame, outer: str, inner: str) -> DataFrame:
    """(resource, scope, s): one row a scope. The maps of a resource and of a scope are built where there is one row of each.

    A record without resources gives a row without scopes, which the second explode drops. A plain explode
    first would be planned with a filter on the records, for which their texts are parsed twice more.
    """
    resources = records.select(F.explode_outer(outer).alias("r")).select(attributes(F.col("r.resource.attributes")).alias("resource"), F.col(f"r.{inner}").alias("scopes"))
    scopes = resources.select("resource", F.explode("scopes").alias("s"))
    return scopes.select("resource", F.struct("s.scope.name", "s.scope.version", attributes(F.col("s.scope.attributes")).alias("held")).alias("scope"), "s")


def spans_raw(records: DataFrame, tenant: str) -> DataFrame:
    """Trace records to raw spans, one row a span."""
    r = _unpacked(records, "resourceSpans", "scopeSpans").select("resource", "scope", F.explode("s.spans").alias("x"))
    x, resource = F.col("x"), F.col("resource")
    events = F.transform(x["events"], lambda e: F.struct(e["timeUnixNano"].alias("ts_ns"), e["name"].alias("name"), attributes(e["attributes"]).alias("attributes")))
    links = F.transform(x["links"], lambda e: F.struct(e["traceId"].alias("trace_id"), e["spanId"].alias("span_id"), e["traceState"].alias("trace_state"), attributes(e["attributes"]).alias("attributes")))
    return r.select(*_cols({
        "tenant_id": F.lit(tenant), **_times(x["startTimeUnixNano"]), "trace_id": F.lower(x["traceId"]), "span_id": F.lower(x["spanId"]), "parent_span_id": F.lower(F.coalesce(x["parentSpanId"], F.lit(""))),
        "trace_state": F.coalesce(x["traceState"], F.lit("")), "span_name": x["name"], "span_kind": span_kind(x["kind"]), "service_name": attr(resource, "service.name"), "resource_attributes": resource,
        "scope_name": F.coalesce("scope.name", F.lit("")), "scope_version": F.coalesce("scope.version", F.lit("")), "scope_attributes": F.col("scope.held"), "span_attributes": attributes(x["attributes"]),
        "duration_ns": F.greatest(x["endTimeUnixNano"] - x["startTimeUnixNano"], F.lit(0)), "status_code": status_code(x["status"]["code"]), "status_message": F.coalesce(x["status"]["message"], F.lit("")), "events": events, "links": links,
    }))


def logs(records: DataFrame, tenant: str, now_ns: Column | int) -> DataFrame:
    """Log records to logs; the time is that of the record, else when it was observed, else now."""
    r = _unpacked(records, "resourceLogs", "scopeLogs").select("resource", "scope", F.explode("s.logRecords").alias("x"))
    x, resource = F.col("x"), F.col("resource")
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    at = F.coalesce(F.nullif(x["timeUnixNano"], F.lit(0)), F.nullif(x["observedTimeUnixNano"], F.lit(0)), now)
    return r.select(*_cols({
        "tenant_id": F.lit(tenant), **_times(at), "trace_id": F.coalesce(F.lower(x["traceId"]), F.lit("")), "span_id": F.coalesce(F.lower(x["spanId"]), F.lit("")), "trace_flags": F.coalesce(x["flags"], F.lit(0)),
        "severity_text": F.coalesce(x["severityText"], F.lit("")), "severity_number": F.coalesce(x["severityNumber"], F.lit(0)), "body": any_value(x["body"]), "service_name": attr(resource, "service.name"), "resource_attributes": resource,
        "scope_name": F.coalesce("scope.name", F.lit("")), "scope_version": F.coalesce("scope.version", F.lit("")), "scope_attributes": F.col("scope.held"), "log_attributes": attributes(x["attributes"]), "event_name": F.coalesce(x["eventName"], F.lit("")),
    }))


def exemplars(list_: Column) -> Column:
    return F.transform(list_, lambda e: F.struct(attributes(e["filteredAttributes"]).alias("attributes"), e["timeUnixNano"].alias("ts_ns"), F.coalesce(e["asDouble"], e["asInt"].cast("double")).alias("value"), e["spanId"].alias("span_id"), e["traceId"].alias("trace_id")))


def metrics(records: DataFrame, tenant: str) -> dict[str, DataFrame]:
    """Metric records to five tables, by the kind of their data."""
    r = _unpacked(records, "resourceMetrics", "scopeMetrics").select("resource", "scope", F.explode("s.metrics").alias("m"))

    def points(kind: str, columns: dict[str, Column]) -> DataFrame:
        p, resource = F.col("p"), F.col("resource")
        rows = r.where(F.col(f"m.{kind}").isNotNull()).select("resource", "scope", "m", F.explode(f"m.{kind}.dataPoints").alias("p"))
        return rows.select(*_cols({
            "tenant_id": F.lit(tenant), "resource_attributes": resource, "scope_name": F.coalesce("scope.name", F.lit("")), "scope_version": F.coalesce("scope.version", F.lit("")), "service_name": attr(resource, "service.name"), "metric_name": F.col("m.name"),
            "metric_description": F.coalesce("m.description", F.lit("")), "metric_unit": F.coalesce("m.unit", F.lit("")), "attributes": attributes(p["attributes"]), "start_ns": F.coalesce(p["startTimeUnixNano"], F.lit(0)), "ts_ns": p["timeUnixNano"], **columns, "flags": F.coalesce(p["flags"], F.lit(0)),
        }))

    p, temporality = F.col("p"), lambda kind: F.coalesce(f"m.{kind}.aggregationTemporality", F.lit(0))
    number = {"value": F.coalesce(p["asDouble"], p["asInt"].cast("double"), F.lit(0.0)), "exemplars": exemplars(p["exemplars"])}
    shape = {"count": p["count"], "sum": F.coalesce(p["sum"], F.lit(0.0)), "min": p["min"], "max": p["max"]}
    side = lambda s: {f"{s}_offset": p[s]["offset"], f"{s}_bucket_counts": p[s]["bucketCounts"]}
    return {
        "metrics_gauge": points("gauge", number),
        "metrics_sum": points("sum", number | {"aggregation_temporality": temporality("sum"), "is_monotonic": F.coalesce("m.sum.isMonotonic", F.lit(False))}),
        "metrics_histogram": points("histogram", shape | {"bucket_counts": p["bucketCounts"], "explicit_bounds": p["explicitBounds"], "exemplars": exemplars(p["exemplars"]), "aggregation_temporality": temporality("histogram")}),
        "metrics_exp_histogram": points("exponentialHistogram", shape | {"scale": p["scale"], "zero_count": p["zeroCount"], **side("positive"), **side("negative"), "exemplars": exemplars(p["exemplars"]), "aggregation_temporality": temporality("exponentialHistogram")}),
        "metrics_summary": points("summary", {"count": p["count"], "sum": p["sum"], "quantiles": p["quantileValues"]}),
    }


def json_attributes(column: str | Column) -> Column:
    """A JSON object in a string as a map of strings."""
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))


def shipper_logs(lines: DataFrame, tenant: str, now_ns: int) -> DataFrame:
    """Rows of a JSON log shipper - objects, or arrays of them, one text each - to logs."""
    fields = "message string, timestamp string, level string, service string, host string, trace_id string, span_id string"
    many = F.when(F.col("value").startswith("["), F.from_json("value", f"array<struct<{fields.replace(' string', ':string')}>>")).otherwise(F.array(F.from_json("value", fields)))
    texts = F.when(F.col("value").startswith("["), F.from_json("value", "array<map<string,string>>")).otherwise(F.array(F.from_json("value", "map<string,string>")))
    x = lines.select(F.explode(F.arrays_zip(many.alias("f"), texts.alias("all"))).alias("x")).select("x.f", "x.all").where("f IS NOT NULL")
    at = F.coalesce(F.unix_micros(F.try_to_timestamp("f.timestamp")) * 1000, F.lit(now_ns))
    known = ["message", "timestamp", "level", "service", "host", "trace_id", "span_id"]
    text, number = severity(F.coalesce("f.level", F.lit("")))
    return x.select(*_cols({
        "tenant_id": F.lit(tenant), **_times(at), "trace_id": F.coalesce("f.trace_id", F.lit("")), "span_id": F.coalesce("f.span_id", F.lit("")), "severity_text": text, "severity_number": number, "body": F.coalesce("f.message", F.lit("")), "service_name": F.coalesce("f.service", F.lit("")),
        "resource_attributes": F.map_filter(F.create_map(F.lit("host.name"), F.col("f.host")), lambda k, v: v.isNotNull()), "log_attributes": F.map_filter("all", lambda k, v: ~k.isin(known)),
    }))


# Severities and their numbers, by status words; other words are INFO, 9.
SEVERITIES = {"DEBUG": (5, ("debug", "trace")), "WARN": (13, ("warn", "warning")), "ERROR": (17, ("error", "err")), "FATAL": (21, ("critical", "fatal", "emergency", "alert"))}


def severity(word: Column) -> tuple[Column, Column]:
    """(text, number) of a status word."""
    w = F.lower(word)
    pick = lambda start, value: reduce(lambda a, kv: a.when(w.isin(*kv[1][1]), value(kv)), SEVERITIES.items(), start)
    return pick(F.when(F.lit(False), ""), lambda kv: kv[0]).otherwise("INFO"), pick(F.when(F.lit(False), 0), lambda kv: kv[1][0]).otherwise(9)


def body_severity(body: Column, status: Column) -> tuple[Column, Column]:
    """Severity by the words of the body, else by the status."""
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(body, F.lit(f" {w} ")) for w in words))
    tests = [("ERROR", 17, has("ERROR", "error")), ("WARN", 13, has("WARN", "WARNING", "warn")), ("DEBUG", 5, has("DEBUG", "debug")), ("FATAL", 21, has("FATAL", "fatal", "CRITICAL")), ("INFO", 9, has("INFO", "info"))]
    text, number = severity(status)
    return reduce(lambda a, t: a.when(t[2], t[0]), tests, F.when(F.lit(False), "")).otherwise(text), reduce(lambda a, t: a.when(t[2], t[1]), tests, F.when(F.lit(False), 0)).otherwise(number)


def epoch_ns(at: Column, now_ns: int) -> Column:
    """Nanoseconds from an epoch time whose unit is told by its size: seconds only up to 10^9, then milliseconds."""
    at = at.cast("bigint")
    return F.when(at.isNull(), F.lit(now_ns)).when(at > 1_000_000_000_000_000, at).when(at > 1_000_000_000, at * 1_000_000).otherwise(at * 1_000_000_000).cast("bigint")


def tags(text: Column) -> Column:
    """``k:v,k2:v2`` as a map; a part without a colon is a key without a value; the last of a key stays."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    pair = lambda p: F.create_map(F.trim(F.substring_index(p, ":", 1)), F.when(F.contains(p, F.lit(":")), F.trim(F.substr(p, F.instr(p, ":") + 1))).otherwise(""))
    return F.aggregate(parts, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != F.trim(F.substring_index(p, ":", 1))), pair(p)))


def _present(pairs: dict[str, Column]) -> Column:
    return F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull() & (v != ""))


def agent_logs(rows: DataFrame, tenant: str, now_ns: int) -> DataFrame:
    """Agent rows (message, status, service, hostname, source, tags, timestamp) to logs."""
    tagged = rows.withColumn("t", tags(F.col("tags")))
    text, number = body_severity(F.col("message"), F.coalesce("status", F.lit("")))
    resource = _present({"host.name": F.col("hostname"), "source": F.col("source"), "deployment.environment": F.col("t")["env"], "service.version": F.col("t")["version"]})
    return tagged.select(*_cols({
        "tenant_id": F.lit(tenant), **_times(epoch_ns(F.col("timestamp"), now_ns)), "severity_text": text, "severity_number": number, "body": F.col("message"), "service_name": F.coalesce("service", F.lit("")), "resource_attributes": resource,
        "log_attributes": F.map_filter("t", lambda k, v: ~k.isin("env", "version")),
    }))


def agent_span_kind(kind: Column) -> Column:
    return F.when(kind.isin("web", "http"), "SPAN_KIND_SERVER").when(kind.isin("client", "dns", "grpc", "db", "cache", "memcached", "redis", "sql", "cassandra", "elasticsearch"), "SPAN_KIND_CLIENT").when(kind.isin("worker", "consumer"), "SPAN_KIND_CONSUMER").when(kind == "producer", "SPAN_KIND_PRODUCER").otherwise("SPAN_KIND_INTERNAL")


def agent_spans(rows: DataFrame, tenant: str) -> DataFrame:
    """Agent spans (numeric ids, meta and metrics maps) to raw spans."""
    hexed = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    numbers = F.transform_values("metrics", lambda k, v: v.cast("string"))
    extra = _present({"resource": F.col("resource"), "type": F.col("type")})
    merged = F.map_concat(F.map_filter("meta", lambda k, v: ~F.map_contains_key(numbers, k)), numbers)
    return rows.select(*_cols({
        "tenant_id": F.lit(tenant), **_times(F.col("start")), "trace_id": hexed(F.col("trace_id"), 32), "span_id": hexed(F.col("span_id"), 16), "parent_span_id": F.when(F.col("parent_id") == 0, "").otherwise(hexed(F.col("parent_id"), 16)), "trace_state": F.lit(""),
        "span_name": F.col("name"), "span_kind": agent_span_kind(F.col("type")), "service_name": F.col("service"), "resource_attributes": _present({"service.name": F.col("service"), "host.name": F.col("hostname"), "deployment.environment": F.col("env"), "service.version": attr("meta", "version")}),
        "span_attributes": F.map_concat(F.map_filter(merged, lambda k, v: ~k.isin("resource", "type")), extra), "duration_ns": F.greatest(F.col("duration"), F.lit(0)), "status_code": F.when(F.col("error") != 0, "STATUS_CODE_ERROR").otherwise("STATUS_CODE_OK"), "status_message": attr("meta", "error.message"),
    }))


def metric_table(kind: Column) -> Column:
    """Where a metric of an agent goes: counts and rates are sums, by name or number."""
    return F.when(F.lower(kind.cast("string")).isin("count", "rate", "1", "2"), "sum").otherwise("gauge")


def agent_metrics(rows: DataFrame, tenant: str) -> DataFrame:
    """Agent series (metric, type, host, tags, points of seconds and value) to metric rows, with a ``kind`` of gauge or sum."""
    x = rows.withColumn("t", tags(F.array_join("tags", ","))).select("*", F.explode("points").alias("p"))
    labels = F.map_concat(F.map_filter("t", lambda k, v: ~k.isin("service", "host.name")), _present({"host.name": F.col("host")}))
    return x.select(*_cols({"tenant_id": F.lit(tenant), "kind": metric_table(F.col("type")), "metric_name": F.col("metric"), "service_name": F.coalesce(F.col("t")["service"], F.lit("")), "attributes": labels, "ts_ns": F.col("p")["timestamp"].cast("bigint") * 1_000_000_000, "value": F.col("p")["value"]}))


def service_checks(rows: DataFrame, tenant: str) -> DataFrame:
    """Service checks (check, status, host, tags, timestamp) as gauges; the prefix of their names is a fixed value."""
    return rows.select(*_cols({"tenant_id": F.lit(tenant), "metric_name": F.concat(F.lit("dd.check."), F.col("check")), "attributes": F.map_concat(F.map_filter(tags(F.array_join("tags", ",")), lambda k, v: k != "host.name"), _present({"host.name": F.col("host")})), "ts_ns": F.col("timestamp").cast("bigint") * 1_000_000_000, "value": F.col("status").cast("double")}))


def gauge_to_sum(gauges: DataFrame, monotonic: bool = True) -> DataFrame:
    return gauges.withColumns({"aggregation_temporality": F.lit(2), "is_monotonic": F.lit(monotonic)})


def remote_write(series: DataFrame, tenant: str, metadata: DataFrame | None = None) -> DataFrame:
    """Series (labels, samples of ms and value) to gauges; help and unit come from the metadata of the metric."""
    x = series.select("labels", F.explode("samples").alias("s"))
    rows = x.select(*_cols({
        "tenant_id": F.lit(tenant), "metric_name": attr("labels", "__name__"), "service_name": attr("labels", "job"), "attributes": F.map_filter("labels", lambda k, v: ~k.isin("__name__", "job")), "ts_ns": F.col("s")["timestamp"].cast("bigint") * 1_000_000, "value": F.col("s")["value"],
    }))
    if metadata is None:
        return rows.withColumns({"metric_description": F.lit(""), "metric_unit": F.lit("")})
    about = metadata.select("metric_name", F.col("help").alias("metric_description"), F.col("unit").alias("metric_unit")).dropDuplicates(["metric_name"])
    return rows.join(about, "metric_name", "left").na.fill("", ["metric_description", "metric_unit"])


def rum_events(batches: DataFrame, tenant: str) -> DataFrame:
    """Batches (meta struct, events array) to one row an event, with the columns of both."""
    return batches.select(F.lit(tenant).alias("tenant_id"), "meta.*", F.explode("events").alias("e")).select("*", "e.*").drop("e")


# ------------------------------------------------------------- derived columns


def wide_spans(raw: DataFrame) -> DataFrame:
    """Raw spans flattened for queries: HTTP fields under old and new names, attributes as JSON."""
    a = lambda key: F.nullif(attr("span_attributes", key), F.lit(""))
    code = F.coalesce(a("http.status_code").try_cast("int"), a("http.response.status_code").try_cast("int"), F.lit(0))
    return raw.select(
        "tenant_id", "ts_ns", "ts", "trace_id", "span_id", "parent_span_id", "service_name", "span_name", F.col("span_kind").alias("kind"), F.col("status_code").alias("status"), "duration_ns",
        F.coalesce(a("http.method"), a("http.request.method"), F.lit("")).alias("http_method"), F.coalesce(a("http.route"), a("http.target"), a("url.path"), F.col("span_name")).alias("http_path"), code.alias("http_status_code"), F.col("span_attributes").alias("attributes"),
        F.transform("events", lambda e: e["name"]).alias("event_names"), F.transform("events", lambda e: e["ts_ns"]).alias("event_timestamps"), F.transform("events", lambda e: F.to_json(e["attributes"])).alias("event_attributes"),
        F.transform("links", lambda e: e["trace_id"]).alias("link_trace_ids"), F.transform("links", lambda e: e["span_id"]).alias("link_span_ids"),
    )


def derived_log_columns(logs: DataFrame) -> DataFrame:
    """Logs with columns for the attributes that detections read."""
    r, l = lambda k: attr("resource_attributes", k), lambda k: attr("log_attributes", k)
    return logs.withColumns({
        "k8s_namespace": r("k8s.namespace.name"), "k8s_pod": r("k8s.pod.name"), "k8s_container": r("k8s.container.name"), "k8s_deployment": r("k8s.deployment.name"), "environment": non_empty(r("deployment.environment"), r("deployment.environment.name")),
        "source_ip": non_empty(l("source.ip"), l("client.address")), "user_name": non_empty(l("user.name"), l("user.id")), "action": non_empty(l("event.action"), l("action")),
    })


def trace_projection(raw: DataFrame) -> DataFrame:
    return raw.select("tenant_id", "trace_id", "ts_ns", "duration_ns", "service_name").sortWithinPartitions("trace_id")


# ------------------------------------------------------------- metric firewall


_RULE = "place:int,metric:string,metric_regex:boolean,label_key:string,label_value:string,label_regex:boolean,drop:string,drop_regex:boolean"
ACTIONS = ("allow", "block", "drop_label")


def _is_regex(spark, pattern: str) -> bool:
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def rule_index(spark, rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(named, scanned): the rules that name a metric literally, one row a metric, and all others in one row.

    Both have a list of rules for each action. Rules that are switched off, allow rules without
    a criterion, drop rules without a label, and rules with a broken expression are left out; an
    unknown action blocks.
    """
    rows, sound = [], cache(lambda pattern: _is_regex(spark, pattern))
    for place, r in enumerate(rules):
        action = r["action"] if r["action"] in ACTIONS else "block"
        patterns = [r.get(p, "") for p in ("metric", "label_value", "drop") if r.get(f"{p.removesuffix('_value')}_regex")]
        bad = (action == "allow" and not (r.get("metric") or r.get("label_key"))) or (action == "drop_label" and not r.get("drop"))
        if not r.get("enabled", True) or bad or not all(map(sound, patterns)):
            continue
        literal = r["metric"] if r.get("metric") and not r.get("metric_regex") else None
        rows.append((literal, action, (place, r.get("metric") or None, bool(r.get("metric_regex")), r.get("label_key") or None, r.get("label_value") or None, bool(r.get("label_regex")), r.get("drop"), bool(r.get("drop_regex")))))
    table = spark.createDataFrame(rows, f"name string, action string, rule struct<{_RULE}>")
    lists = [F.array_sort(F.collect_list(F.when(F.col("action") == a, F.col("rule")))).alias(f"{a}_") for a in ACTIONS]
    return table.where("name IS NOT NULL").groupBy("name").agg(*lists), table.where("name IS NULL").agg(*lists)


def _applies(rule: Column, labels: Column) -> Column:
    """Whether a rule's metric and label conditions hold; null ones always do."""
    fits = lambda pattern, regex, value: pattern.isNull() | F.when(regex, F.regexp_like(value, pattern)).otherwise(value == pattern)
    held = F.try_element_at(labels, rule["label_key"])
    label = rule["label_key"].isNull() | (held.isNotNull() & fits(rule["label_value"], rule["label_regex"], held))
    return F.coalesce(fits(rule["metric"], rule["metric_regex"], F.col("metric_name")) & label, F.lit(False))


def firewall(samples: DataFrame, rules: list[dict]) -> DataFrame:
    """Block samples, but those that an allow rule exempts, and drop labels.

    A rule has an ``action`` - ``allow``, ``block`` or ``drop_label`` - and may name a
    metric, a label key and a label value, literally or as regular expressions. Rules that name
    a metric are looked up by it, in one hash join; only the others are tried one by one. Drop rules
    act in order, each on the labels that are left. The rules are a list of the caller's
    and broadcast; the plan has the same size for any number of them.
    """
    spark = samples.sparkSession
    named, scanned = rule_index(spark, rules)
    one = scanned.select(*(F.col(f"{a}_").alias(f"any_{a}") for a in ACTIONS))
    found = samples.join(F.broadcast(named), F.col("metric_name") == F.col("name"), "left").join(F.broadcast(one))  # one row
    of = lambda a: F.concat(F.coalesce(f"{a}_", F.array().cast(f"array<struct<{_RULE}>>")), f"any_{a}")
    hit = lambda a: F.exists(of(a), lambda r: _applies(r, F.col("attributes")))
    kept = found.where(hit("allow") | ~hit("block"))
    gone = lambda r, key: F.when(r["drop_regex"], F.regexp_like(key, r["drop"])).otherwise(key == r["drop"])
    left = F.aggregate(F.array_sort(of("drop_label")), F.col("attributes"), lambda labels, r: F.when(_applies(r, labels), F.map_filter(labels, lambda k, v: ~gone(r, k))).otherwise(labels))
    return kept.withColumn("attributes", left).select(*samples.columns)
