"""Scans of stored signals, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.schemas import TABLES


def scan(spark: SparkSession, root: str, signal: str, tenant: str | None = None, start=None, end=None) -> DataFrame:
    """A stored table; tenant and date bounds prune partitions, ``ts`` bounds prune row groups."""
    df = spark.read.schema(TABLES[signal]).parquet(f"{root}/{signal}")
    return bounded(df, tenant, start, end)


def bounded(df: DataFrame, tenant: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of a tenant between two times, both included; dates of a partitioned table are bounded too."""
    if tenant is not None:
        df = df.where(F.col("tenant_id") == tenant)
    at = next((c for c in ("ts", "chunk_ts", "bucket", "ts_ns") if c in df.columns), None)
    for bound, late in ((start, False), (end, True)):
        if bound is None:
            continue
        time = F.lit(bound).cast("timestamp")
        edge = F.unix_micros(time) * 1000 if at == "ts_ns" else time
        df = df.where(F.col(at) <= edge if late else F.col(at) >= edge)
        if "date" in df.columns:
            df = df.where(F.col("date") <= F.to_date(time) if late else F.col("date") >= F.to_date(time))
    return df


def append(df: DataFrame, root: str, signal: str, sort: tuple[str, ...] = ("tenant_id", "service_name", "ts_ns")) -> None:
    """Append rows by date, sorted within files so that statistics prune."""
    named = next((c for c in ("ts", "chunk_ts", "bucket") if c in df.columns), None)
    at = F.col(named) if named else F.timestamp_micros((F.col("ts_ns") / 1000).cast("long"))
    keys = [c for c in sort if c in df.columns]
    df.withColumn("date", F.to_date(at)).sortWithinPartitions(*keys).write.mode("append").partitionBy("date").parquet(f"{root}/{signal}")


def store_by_trace(df: DataFrame, path: str, files: int | None = None, ndv: int = 1_000_000) -> None:
    """Rows in files of ranges of trace ids, sorted, with Bloom filters of trace and span ids.

    A lookup of a trace opens the files whose range holds it and reads the row groups whose
    filter may; ``ndv`` is the number of different ids that a filter is made for.
    """
    ranged = df.repartitionByRange(files, "trace_id") if files else df.repartitionByRange("trace_id")
    writer = ranged.sortWithinPartitions("trace_id", *(c for c in ("ts_ns",) if c in df.columns)).write
    for column in (c for c in ("trace_id", "span_id") if c in df.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(ndv))
    writer.parquet(path)


#: Settings with which tables of ``save_bucketed`` meet by their buckets where a join has more keys.
BY_BUCKET = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def save_bucketed(df: DataFrame, name: str, buckets: int, key: str = "trace_id") -> None:
    """A catalog table in buckets of ``key``: joins and aggregations by it need no shuffle, given ``BY_BUCKET``."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)


#: Rows of an export, at most.
MOST_ROWS = 1_000_000


def _exported(df: DataFrame, max_rows: int, path: str, note: dict | None) -> DataFrame:
    """The rows of an export; its side file says how many there are, and whether rows were left out."""
    if max_rows > MOST_ROWS:
        raise ValueError(f"an export has {MOST_ROWS} rows at most; write a table instead")
    if note is not None:
        found = df.limit(max_rows + 1).count()
        _note(df.sparkSession, path, {**note, "rows": min(found, max_rows), "truncated": found > max_rows})
    return df.limit(max_rows)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, max_rows: int = 1000, note: dict | None = None) -> None:
    """CSV of chosen columns with RFC 3339 times; the preamble goes to a file of its own.

    ``max_rows`` is the limit of an export, a million at most; with a ``note``, the side file
    has the number of rows and whether the limit has cut the rest.
    """
    picked = _exported(df.select(*(columns or df.columns)), max_rows, path, note)
    stamps = {c for c, t in picked.dtypes if t.startswith("timestamp")}
    text = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c) if c in stamps else F.col(c).cast("string").alias(c) for c in picked.columns]
    picked.select(*text).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, max_rows: int = 1000, note: dict | None = None) -> None:
    """JSON lines, with the limit and the side file of ``export_csv``."""
    _exported(df, max_rows, path, note).write.mode("overwrite").json(path)


def _note(spark: SparkSession, path: str, note: dict) -> None:
    spark.createDataFrame([(json.dumps(note, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_query")
