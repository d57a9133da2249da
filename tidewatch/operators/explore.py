"""Explore queries on spans and logs: series, groups, comparison of windows, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.core import attr, bucket, is_error, milliseconds, percentiles
from tidewatch.functions.predicates import before, log_field, span_field


def count_buckets(spans: DataFrame, seconds: int) -> DataFrame:
    """(bucket, total, errors) of spans; errors by span status or HTTP status."""
    return spans.groupBy(bucket(seconds).alias("bucket")).agg(F.count("*").alias("total"), F.count_if(is_error()).alias("errors"))


def log_count_buckets(logs: DataFrame, seconds: int) -> DataFrame:
    """(bucket, total, errors) of logs; errors from severity 17."""
    return logs.groupBy(bucket(seconds).alias("bucket")).agg(F.count("*").alias("total"), F.count_if(F.col("severity_number") >= 17).alias("errors"))


def red(error_mode: str = "http", approx: bool = True) -> list[Column]:
    """Rate, errors and durations in milliseconds, as aggregates of one pass."""
    marks = percentiles(milliseconds(), 0.5, 0.95, 0.99, approx=approx)
    return [F.count("*").alias("total"), F.count_if(is_error(error_mode)).alias("errors"), F.avg(milliseconds()).alias("avg_ms"), marks.alias("_p")]


def _spread(df: DataFrame) -> DataFrame:
    return df.withColumns({f"p{p}_ms": F.col("_p")[i] for i, p in enumerate((50, 95, 99))}).drop("_p")


def red_timeseries(spans: DataFrame, seconds: int, by: str | None = None, error_mode: str = "http", approx: bool = True) -> DataFrame:
    """Rate, errors and durations per bucket, and per value of a field."""
    keys = [bucket(seconds).alias("bucket")] + ([span_field(by).cast("string").alias("grp")] if by else [])
    return _spread(spans.groupBy(*keys).agg(*red(error_mode, approx)))


def group_top(df: DataFrame, field: str, limit: int = 100, logs: bool = False, agg: Column | None = None) -> DataFrame:
    """(value, total) of the most frequent values of a field; ties by value."""
    column = (log_field if logs else span_field)(field).cast("string")
    return df.groupBy(column.alias("value")).agg((F.count("*") if agg is None else agg).alias("total")).orderBy(F.desc("total"), "value").limit(limit)


def compare_windows(df: DataFrame, dimensions: dict[str, Column], selected: Column, baseline: Column, top_k: int = 10) -> DataFrame:
    """Values that are more frequent in one window than in another, for many dimensions in one scan.

    (dimension, value, selected, baseline, selected_pct, baseline_pct, lift), the ``top_k``
    values of each dimension by count in the selection, then by value.
    """
    names = list(dimensions)
    picked = df.select(*(c.cast("string").alias(n) for n, c in dimensions.items()), selected.alias("_in"), baseline.alias("_out")).where("_in OR _out")
    # Without a dimension all rows form one set, which gives the totals in the same scan.
    sets = picked.groupingSets([*([F.col(n)] for n in names), []], *names).agg(F.count_if("_in").alias("selected"), F.count_if("_out").alias("baseline"), F.grouping_id().alias("_set"))
    everything = (1 << len(names)) - 1
    which = {everything - (1 << (len(names) - 1 - i)): i for i in range(len(names))}
    dimension = reduce(lambda a, kv: a.when(F.col("_set") == kv[0], F.lit(names[kv[1]])), which.items(), F.when(F.lit(False), ""))
    value = reduce(lambda a, kv: a.when(F.col("_set") == kv[0], F.col(names[kv[1]])), which.items(), F.when(F.lit(False), ""))
    rows = sets.select(dimension.alias("dimension"), value.alias("value"), "selected", "baseline", "_set")
    totals = rows.where(F.col("_set") == everything).select(F.col("selected").alias("_s"), F.col("baseline").alias("_b"))
    best = Window.partitionBy("dimension").orderBy(F.desc("selected"), "value")
    kept = rows.where((F.col("_set") != everything) & (F.col("selected") > 0)).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= top_k)
    pct = lambda n, of: F.col(n) * 100.0 / F.greatest(F.col(of), F.lit(1))
    joined = kept.join(F.broadcast(totals)).withColumns({"selected_pct": pct("selected", "_s"), "baseline_pct": pct("baseline", "_b")})  # totals are one row
    lift = F.round(F.col("selected_pct") / F.greatest("baseline_pct", F.lit(0.01)), 2)
    return joined.select("dimension", "value", "selected", "baseline", F.round("selected_pct", 2).alias("selected_pct"), F.round("baseline_pct", 2).alias("baseline_pct"), lift.alias("lift"))


#: Rows of a page, and the rows before it, at most; further pages are reached by ``keyset_page``.
PAGE, DEEPEST = 1000, 50_000


def _page_bounds(limit: int, offset: int = 0) -> None:
    if limit > PAGE or offset > DEEPEST:
        raise ValueError(f"a page has {PAGE} rows at most and begins after {DEEPEST} at most; go on with a cursor")


def newest(df: DataFrame, limit: int = 100, offset: int = 0, columns: list[str] | None = None) -> DataFrame:
    """A page, newest first."""
    _page_bounds(limit, offset)
    page = df.orderBy(F.desc("ts_ns"), F.desc("span_id")).offset(offset).limit(limit)
    return page.select(*columns) if columns else page


def keyset_page(df: DataFrame, limit: int = 100, cursor: tuple[int, str] | None = None) -> DataFrame:
    """The page after a cursor; the next cursor is the (ts_ns, span_id) of its last row."""
    _page_bounds(limit)
    rows = df.where(before(cursor)) if cursor else df
    return rows.orderBy(F.desc("ts_ns"), F.desc("span_id")).limit(limit)


def next_cursor(page: DataFrame, limit: int) -> tuple[int, str] | None:
    """Where the next page starts, or None where this one was not full."""
    row = page.agg(F.count("*").alias("n"), F.min_by(F.struct("ts_ns", "span_id"), F.struct("ts_ns", "span_id")).alias("last")).first()
    return (row.last.ts_ns, row.last.span_id) if row.n == limit else None


def log_page(logs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    _page_bounds(limit, offset)
    return logs.orderBy(F.desc("ts_ns"), F.desc("span_id")).offset(offset).limit(limit)


def capped_count(df: DataFrame, cap: int = 10_000) -> DataFrame:
    """(total): the number of rows, counted up to a cap."""
    return df.select(F.lit(1).alias("one")).limit(cap).agg(F.count("*").alias("total"))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    at = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def latest_rows(df: DataFrame, key: str = "id", version: str = "version", deleted: str = "is_deleted") -> DataFrame:
    """The newest version of each key, without keys that were deleted."""
    newest_row = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(version)).alias("_row"))
    return newest_row.select("_row.*").where(F.col(deleted) == 0)


def suggest_values(df: DataFrame, field: Column, start: str = "", limit: int = 50) -> DataFrame:
    """(value): distinct values that begin with a prefix, the most frequent first."""
    values = df.select(field.cast("string").alias("value")).where(F.col("value").isNotNull() & (F.col("value") != ""))
    if start:
        values = values.where(F.col("value").startswith(start))
    return values.groupBy("value").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "value").limit(limit)


def series_list(samples: DataFrame, limit: int = 1000) -> DataFrame:
    """(series_key): distinct label sets."""
    return samples.select("series_key").distinct().orderBy("series_key").limit(limit)


def label_names(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode(F.map_keys("labels")).alias("label")).distinct()


def label_values(samples: DataFrame, label: str) -> DataFrame:
    return samples.select(attr("labels", label).alias("value")).where("value <> ''").distinct()


def autocomplete(tables: list[DataFrame], kind: str, start: str = "", key: str | None = None, limit: int = 50) -> DataFrame:
    """(value) that begins with a prefix: metric, label_key, label_value, service or endpoint, over several tables."""
    pick = {
        "metric": lambda: F.col("metric_name"), "service": lambda: F.col("service_name"), "label_value": lambda: attr("attributes", key or ""),
        "endpoint": lambda: F.col("http_path"), "label_key": lambda: F.explode(F.map_keys("attributes")),
    }[kind]
    values = reduce(DataFrame.unionByName, [t.select(pick().alias("value")).distinct() for t in tables])
    return values.where((F.col("value") != "") & F.col("value").startswith(start)).distinct().orderBy("value").limit(limit)
