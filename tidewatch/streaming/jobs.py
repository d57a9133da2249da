"""Streaming twins: the same functions as in batch, with an explicit policy for late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewatch.functions.core import scratch
from tidewatch.operators import rollup, rules, states


def read(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def transform_to(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """Append what a stateless job makes of a stream, such as ``wide_spans``."""
    return transform(stream).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup_partials(stream: DataFrame, path: str, checkpoint: str, seconds: int = 60):
    """Append mergeable partial rows a batch. However late a row is, it only adds a partial; readers merge.

    A batch that is run again overwrites its own rows.
    """
    def write(batch: DataFrame, number: int) -> None:
        rollup.rollup(batch, seconds).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup_windows(stream: DataFrame, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """(series_key, bucket, sum, cnt, min, max): windows that close; rows later than the watermark are dropped."""
    at = F.window("ts", f"{seconds} seconds")
    return stream.withWatermark("ts", lateness).groupBy("series_key", at).agg(F.sum("value").alias("sum"), F.count("*").alias("cnt"), F.min("value").alias("min"), F.max("value").alias("max")).select("series_key", F.unix_seconds("window.start").alias("bucket"), "sum", "cnt", "min", "max")


def usage(stream: DataFrame, signal: str, size: str, lateness: str = "2 hours") -> DataFrame:
    """(tenant_id, signal, bucket, events_count, bytes_count) for each hour; ``size`` is the column that is metered."""
    hours = stream.withWatermark("ts", lateness).groupBy("tenant_id", F.window("ts", "1 hour")).agg(F.count("*").alias("events_count"), F.sum(F.length(size)).alias("bytes_count"))
    return hours.select("tenant_id", F.lit(signal).alias("signal"), F.col("window.start").alias("bucket"), "events_count", "bytes_count")


def track_queries(stream: DataFrame, path: str, checkpoint: str):
    """Append the queried signals of a batch, each counted once; readers take the latest."""
    def write(batch: DataFrame, number: int) -> None:
        keys = ["tenant_id", "signal_name", "signal_type", "source"]
        batch.groupBy(*keys).agg(F.max("ts").alias("last_queried_at"), F.count("*").alias("query_count")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_windows(stream: DataFrame, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions by inactivity, for browser events that come without an id."""
    grouped = stream.withWatermark("ts", lateness).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return grouped.select(key, F.unix_seconds("session_window.start").alias("started"), F.unix_seconds("session_window.end").alias("ended"), "events")


def first_spans(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def slo_hours(stream: DataFrame, bad, lateness: str = "1 hour") -> DataFrame:
    """(service_name, bucket, bad, total) for each hour; rolling windows add hours up at read."""
    hours = stream.withWatermark("ts", lateness).groupBy("service_name", F.window("ts", "1 hour")).agg(F.count_if(bad).alias("bad"), F.count("*").alias("total"))
    return hours.select("service_name", F.unix_seconds("window.start").alias("bucket"), "bad", "total")


def rolling(hours: DataFrame, hours_back: int) -> DataFrame:
    """Hourly counts added up over the last hours, at every hour."""
    span = f"PARTITION BY service_name ORDER BY bucket RANGE BETWEEN {hours_back * 3600 - 1} PRECEDING AND CURRENT ROW"
    return hours.select("service_name", "bucket", F.expr(f"sum(bad) OVER ({span})").alias("bad"), F.expr(f"sum(total) OVER ({span})").alias("total"))


def sliding_means(samples: DataFrame, window: str, slide: str, lateness: str = "10 minutes") -> DataFrame:
    """(rule_id, grp, at, value): means of (rule_id, grp, ts, value) over windows that end at ``at``, in seconds, once no row can come for them."""
    at = F.window("ts", window, slide)
    means = samples.withWatermark("ts", lateness).groupBy("rule_id", "grp", at).agg(F.avg("value").alias("value"))
    return means.select("rule_id", "grp", F.unix_seconds("window.end").alias("at"), "value")


class ThresholdMonitor(StatefulProcessor):
    """Keeps the state of each (rule, group) and emits its changes; values come as (at, value), ``at`` in seconds.

    The states are those of ``states.step``. A null or NaN value is a tick without
    data, which resolves the rule or leaves it in no_data. With ``silence_s``, so does a group
    that sends no value for so many seconds of event time: a timer is moved on with each value.
    """

    def __init__(self, critical: float | None, critical_recovery: float | None = None, warning: float | None = None, warning_recovery: float | None = None, comparator: str = "above", no_data_action: str = "notify", silence_s: int | None = None):
        self.limits = (critical, critical_recovery, warning, warning_recovery, comparator)
        self.missing, self.silence_s = "ok" if no_data_action == "resolve" else "no_data", silence_s

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "name string, last bigint")

    def after(self, now: str, value: float | None) -> str:
        return self.missing if value is None or value != value else states.state_after(now, value, *self.limits)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The state that a batch has left, as (state)."""
        for name in initialState["state"]:
            self.state.update((name, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, last = self.state.get() if self.state.exists() else ("ok", 0)
        changes = []
        for at, value in pd.concat(list(rows))[["at", "value"]].sort_values("at").itertuples(index=False):
            new = self.after(now, value)
            if new != now:
                changes.append((*key, at, value, now, new))
            now, last = new, max(last, int(at))
        self.state.update((now, last))
        if self.silence_s is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((last + self.silence_s) * 1000)
        yield _changes(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, last = self.state.get()
        self.state.update((self.missing, last))
        yield _changes([(*key, last + self.silence_s, None, now, self.missing)] if now != self.missing else [])

    def close(self) -> None:
        pass


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["rule_id", "grp", "at", "value", "old_state", "new_state"]).astype({"value": "float64"})


class EwmaMonitor(StatefulProcessor):
    """Keeps the band of each series (``rules.Band``) and emits a verdict for each value after its warm-up."""

    def __init__(self, sensitivity: float = 3.0, alpha: float = 0.25):
        self.sensitivity, self.alpha = sensitivity, alpha

    def init(self, handle) -> None:
        self.state = handle.getValueState("band", "mean double, var double, floor double, warm array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The band that a batch has left, as ``rules.ewma_bands`` gives it."""
        for mean, var, floor, warm in initialState[["mean", "var", "floor", "warm"]].itertuples(index=False):
            self.state.update((mean, var, floor, None if warm is None else [float(x) for x in warm]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        band = rules.Band(self.sensitivity, self.alpha, *([tuple(self.state.get())] if self.state.exists() else []))
        out = []
        for at, x in pd.concat(list(rows))[["at", "value"]].sort_values("at").itertuples(index=False):
            if band.see(float(x)):
                out.append((*key, at, float(x), bool(band.hit)))
        self.state.update(band.saved())
        yield pd.DataFrame(out, columns=["series_key", "at", "value", "anomalous"])

    def close(self) -> None:
        pass


TRANSITIONS = "rule_id string, grp string, at bigint, value double, old_state string, new_state string"
VERDICTS = "series_key string, at bigint, value double, anomalous boolean"


def monitor(values: DataFrame, processor: ThresholdMonitor, initial: DataFrame | None = None) -> DataFrame:
    """State changes of a stream of (rule_id, grp, at, value); needs the RocksDB state store.

    With ``silence_s``, values come with a watermark, such as those of ``sliding_means``.
    ``initial`` (rule_id, grp, state) is what the groups begin with.
    """
    mode = "none" if processor.silence_s is None else "eventTime"
    begun = initial.groupBy("rule_id", "grp") if initial is not None else None
    return values.groupBy("rule_id", "grp").transformWithStateInPandas(processor, TRANSITIONS, "append", mode, begun)


def anomalies(values: DataFrame, processor: EwmaMonitor, initial: DataFrame | None = None) -> DataFrame:
    """Verdicts of a stream of (series_key, at, value); ``initial`` are the bands that history has left."""
    begun = initial.groupBy("series_key") if initial is not None else None
    return values.groupBy("series_key").transformWithStateInPandas(processor, VERDICTS, "append", "none", begun)


def detect_each_batch(stream: DataFrame, rule: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run a detection on every micro-batch and keep what it finds by ``batch``; one that is run again overwrites its own rows."""
    def write(batch: DataFrame, number: int) -> None:
        rule(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, spark: SparkSession, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all files that are there, into a table of its own, and read it."""
    path = scratch(spark, label)
    if mode == "append":
        query = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(df.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)
