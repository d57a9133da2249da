"""Column functions that all areas share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = {"1s": 1, "10s": 10, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1d": 86400}


def attr(attributes: str | Column, key: str) -> Column:
    """An attribute, or the empty string where it is missing."""
    return F.coalesce(F.try_element_at(F.col(attributes) if isinstance(attributes, str) else attributes, F.lit(key)), F.lit(""))


def non_empty(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def scope(df: DataFrame, tenant: str) -> DataFrame:
    return df.where(F.col("tenant_id") == tenant)


def normalize_status(status: str | Column) -> Column:
    """All spellings of a span status as OK, ERROR or UNSET."""
    word = F.upper(F.regexp_replace(F.col(status) if isinstance(status, str) else status, "(?i)^STATUS_CODE_", ""))
    return F.when(word.isin("OK", "ERROR"), word).otherwise("UNSET")


def is_error(mode: str = "status_or_http") -> Column:
    """Error spans: by HTTP status, by span status, or by either."""
    http, status = F.col("http_status_code") >= 500, normalize_status("status") == "ERROR"
    return F.coalesce({"http": http, "status": status, "status_or_http": http | status}[mode], F.lit(False))


def clamp_bucket(interval: str, start_s: float, end_s: float, max_buckets: int = 2000) -> int:
    """Seconds of the smallest bucket, no finer than asked for, with at most ``max_buckets`` in the range."""
    if end_s <= start_s:
        raise ValueError("the range is empty")
    asked = BUCKETS.get(interval, 60)
    coarser = [s for s in sorted(BUCKETS.values()) if s >= asked]
    return next((s for s in coarser if (end_s - start_s) / s <= max_buckets), coarser[-1])


def bucket(seconds: int, ts: str | Column = "ts") -> Column:
    """Start of the time bucket, as seconds since the epoch."""
    at = F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))
    return (F.floor(at / seconds) * seconds).cast("bigint")


def milliseconds(ns: str = "duration_ns") -> Column:
    return F.col(ns) / 1e6


def percentiles(value: Column, *points: float, approx: bool = True) -> Column:
    """Percentiles by a mergeable estimate, whose rank is off by at most 0.01 percent; exact and linearly interpolated ones hold all values of a group."""
    marks = F.array(*map(F.lit, points))
    return F.percentile_approx(value, marks, 10_000) if approx else F.percentile(value, marks)


def percentile(value: Column, point: float, approx: bool = True) -> Column:
    """One percentile, estimated or exact as in ``percentiles``."""
    return F.percentile_approx(value, point, 10_000) if approx else F.percentile(value, point)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` has named.

    On a local master a temporary folder is made if neither is set; on any other that is
    an error, since executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Folders made by ``scratch`` and not removed yet, by application.
_WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; it stays until ``release``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once into the shared folder, with options of the Parquet writer, and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation, and
    several consumers share one computation. The folder stays until ``release``.
    """
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession, keep_last: int = 0) -> None:
    """Remove what this application has written to the shared folder, but the ``keep_last`` newest folders.

    For use once all results that read those folders have been written.
    """
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    while len(paths) > keep_last:
        _remove(spark, paths.pop(0))


def discard(df: DataFrame) -> None:
    """Remove the folder of one materialised frame that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        name = file.rpartition("/")[0].rpartition("/")[2]
        paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
        for known in [p for p in paths if p.rpartition("/")[2] == name]:
            paths.remove(known)
            _remove(spark, known)


def label_set(metric: str, service: str, attributes: str) -> Column:
    """Labels of a sample: name, service and attributes, without empty values."""
    named = F.create_map(F.lit("__name__"), F.col(metric), F.lit("service_name"), F.col(service))
    rest = F.map_filter(attributes, lambda k, v: ~k.isin("__name__", "service_name"))
    return F.map_filter(F.map_concat(named, F.coalesce(rest, F.create_map().cast("map<string,string>"))), lambda k, v: v.isNotNull() & (v != ""))


def series_key(labels: str | Column) -> Column:
    """Canonical text of a label set: equal maps have equal keys, whatever their order."""
    entries = F.array_sort(F.map_entries(F.col(labels) if isinstance(labels, str) else labels))
    return F.to_json(F.map_from_entries(entries))


def threshold(value: Column, op: str, limit: Column | float, epsilon: float = 2.220446049250313e-16) -> Column:
    """Comparison by operator name; equality allows for rounding."""
    limit = F.lit(limit) if not isinstance(limit, Column) else limit
    near = F.abs(value - limit) < epsilon
    return {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit, "=": near, "==": near, "!=": ~near}[op]
