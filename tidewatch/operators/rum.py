"""Browser events: vitals, pages, errors, sessions, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.core import percentile


def vitals(rum: DataFrame, approx: bool = True) -> DataFrame:
    """(vital_name, samples, p75, good_pct, improve_pct, poor_pct)."""
    share = lambda rating: F.round(F.count_if(F.col("vital_rating") == rating) * 100.0 / F.count("*"), 2)
    rows = rum.where("event_type = 'web_vital'")
    return rows.groupBy("vital_name").agg(F.count("*").alias("samples"), percentile(F.col("vital_value"), 0.75, approx).alias("p75"), share("good").alias("good_pct"), share("needs-improvement").alias("improve_pct"), share("poor").alias("poor_pct"))


def pages(rum: DataFrame) -> DataFrame:
    """(page_path, views, sessions, avg_ms, errors); the mean is over positive durations."""
    return rum.groupBy("page_path").agg(
        F.count_if(F.col("event_type") == "pageview").alias("views"), F.countDistinct("session_id").alias("sessions"), F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))).alias("avg_ms"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


def errors(rum: DataFrame) -> DataFrame:
    """(error_message, total, sessions, last_seen, stack); the stack is the first one seen."""
    rows = rum.where("event_type = 'error'")
    return rows.groupBy("error_message").agg(F.count("*").alias("total"), F.countDistinct("session_id").alias("sessions"), F.max(F.unix_micros("ts")).alias("last_seen"), F.min_by("error_stack", F.struct("ts", "event_id")).alias("stack"))


def sessions(rum: DataFrame) -> DataFrame:
    """(session_id, user_id, browser, pages, errors, seconds, first_seen)."""
    first = lambda c: F.min_by(c, F.struct("ts", "event_id"))
    start, end = F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))
    return rum.groupBy("session_id").agg(
        first("user_id").alias("user_id"), first("browser_name").alias("browser"), F.count_if(F.col("event_type") == "pageview").alias("pages"), F.count_if(F.col("event_type") == "error").alias("errors"), ((end - start) / 1e6).alias("seconds"), start.alias("first_seen")
    )


def apps(rum: DataFrame) -> DataFrame:
    return rum.groupBy("app_name").agg(F.count("*").alias("events"))


def timeline(rum: DataFrame, session: str, limit: int = 1000) -> DataFrame:
    """A session's events, oldest first."""
    return rum.where(F.col("session_id") == session).orderBy("ts", "event_id").limit(limit)


def replay(chunks: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """(session_id, events): recorded JSON arrays joined in order of their chunks; of the first ``max_chunks``, if that is given."""
    wanted = chunks if max_chunks is None else chunks.where(F.col("chunk_idx") < max_chunks)
    parsed = wanted.withColumn("part", F.from_json("events_json", "array<string>"))
    ordered = F.sort_array(F.collect_list(F.struct("chunk_idx", "part")))
    return parsed.groupBy("session_id").agg(F.flatten(F.transform(ordered, lambda c: c["part"])).alias("events"))


def replay_sessions(chunks: DataFrame) -> DataFrame:
    return chunks.select("session_id").distinct()


def synthetic_spans(rum: DataFrame) -> DataFrame:
    """Spans of the browser for events that carry trace and span ids."""
    carried = rum.where("trace_id <> '' AND span_id <> ''")
    extra = F.map_filter(F.create_map(*(x for c in ("session_id", "page_path", "event_type") for x in (F.lit(f"rum.{c}"), F.col(c)))), lambda k, v: v.isNotNull())
    return carried.select(
        "tenant_id", (F.unix_micros("ts") * 1000).alias("ts_ns"), "ts", "trace_id", "span_id", F.lit("").alias("parent_span_id"), F.col("app_name").alias("service_name"), F.concat_ws(" ", "event_type", "page_path").alias("span_name"),
        F.lit("SPAN_KIND_CLIENT").alias("kind"), F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"), (F.col("duration_ms") * 1e6).cast("bigint").alias("duration_ns"), F.to_json(extra).alias("attributes"),
    )
