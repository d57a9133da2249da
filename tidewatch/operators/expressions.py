"""Composed time-series expressions: values that know what they read before anything is read.

An expression is a tree of small immutable nodes, made by functions and ``+ - * /``. From the
tree follow the metrics and the time that a scan has to give, and equal parts of it are
computed once. Evaluation is that of ``series``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import series


class Node:
    """A part of an expression; ``parts`` are the nodes that it is made of."""

    parts: tuple[Node, ...] = ()

    def __add__(self, other: Node) -> Node:
        return Binary("+", self, other)

    def __sub__(self, other: Node) -> Node:
        return Binary("-", self, other)

    def __mul__(self, other: Node) -> Node:
        return Binary("*", self, other)

    def __truediv__(self, other: Node) -> Node:
        return Binary("/", self, other)

    def metrics(self) -> set[Metric]:
        """The selectors at the leaves."""
        return {m for p in self.parts for m in p.metrics()}


@dataclass(frozen=True)
class Metric(Node):
    """Series of a metric with some labels; with a range for a function over time; ``offset_ms`` looks so far back."""

    name: str
    labels: tuple[tuple[str, str], ...] = ()
    range_ms: int | None = None
    offset_ms: int = 0

    def metrics(self) -> set[Metric]:
        return {self}

    def over(self, function: str, param: float | None = None) -> Node:
        return Over(function, self, param)


@dataclass(frozen=True)
class Over(Node):
    function: str
    metric: Metric
    param: float | None = None

    def __post_init__(self):
        if self.metric.range_ms is None:
            raise ValueError("a function over time needs a metric with a range")

    @property
    def parts(self) -> tuple[Node, ...]:
        return (self.metric,)


@dataclass(frozen=True)
class Aggregate(Node):
    op: str
    of: Node
    by: tuple[str, ...] | None = None
    without: tuple[str, ...] | None = None
    param: float | None = None

    @property
    def parts(self) -> tuple[Node, ...]:
        return (self.of,)


@dataclass(frozen=True)
class Apply(Node):
    """A function of every value, such as ``abs``."""

    name: str
    of: Node
    args: tuple[float, ...] = ()

    @property
    def parts(self) -> tuple[Node, ...]:
        return (self.of,)


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    on: tuple[str, ...] | None = None
    ignoring: tuple[str, ...] | None = None
    group: str | None = None

    @property
    def parts(self) -> tuple[Node, ...]:
        return (self.left, self.right)


def lookback(node: Node) -> int:
    """How far before its grid an expression reads, in milliseconds: its longest range and offset; five minutes where a metric has no range."""
    return max((series.lookback(*([m.range_ms] if m.range_ms is not None else [])) + m.offset_ms for m in node.metrics()), default=series.lookback())


def scan_bound(node: Node, grid: series.Grid) -> Column:
    """The condition on samples (metric_name, ts, ts_ms) that an expression reads: what a stored table is asked for.

    One range of times for each metric, so that the offset of one does not widen the others;
    ``ts`` is bounded by all of them together, for partitions and row groups.
    """
    half = grid.step_ms // 2 if grid.steps > 1 else max(grid.end_ms - grid.start_ms, 5000)
    tests, low, high = F.lit(False), [], []
    for m in sorted(node.metrics(), key=repr):
        back, ahead = (m.range_ms, 0) if m.range_ms is not None else (half, half)
        low.append(grid.start_ms - back - m.offset_ms)
        high.append(grid.end_ms + ahead - m.offset_ms)
        tests = tests | ((F.col("metric_name") == m.name) & F.col("ts_ms").between(low[-1], high[-1]))
    if not low:
        return tests
    time = lambda ms: F.timestamp_millis(F.lit(ms))
    names = F.col("metric_name").isin(sorted({m.name for m in node.metrics()}))
    return names & (F.col("ts") >= time(min(low))) & (F.col("ts") <= time(max(high) + 1)) & tests


def evaluate(node: Node, samples: DataFrame, grid: series.Grid) -> DataFrame:
    """(series_key, labels, k, value) of an expression over samples (metric_name, series_key, labels, ts, ts_ms, value)."""
    rows = samples.where(scan_bound(node, grid)).select("metric_name", "series_key", "labels", "ts_ms", "value")
    done: dict[Node, DataFrame] = {}

    def selected(m: Metric) -> DataFrame:
        found = rows.where(F.col("metric_name") == m.name)
        for key, value in m.labels:
            found = found.where(F.col("labels")[key] == value)
        return found.withColumn("ts_ms", F.col("ts_ms") + m.offset_ms) if m.offset_ms else found

    def value(n: Node) -> DataFrame:
        if n not in done:
            done[n] = compute(n)
        return done[n]

    def compute(n: Node) -> DataFrame:
        many = lambda names: None if names is None else list(names)
        match n:
            case Metric():
                return series.instant_select(selected(n), grid)
            case Over():
                return series.range_function(selected(n.metric), grid, n.metric.range_ms, n.function, n.param)
            case Aggregate():
                return series.aggregate(value(n.of), n.op, many(n.by), many(n.without), n.param)
            case Apply():
                return series.scalar(value(n.of), n.name, *n.args, grid=grid)
            case Binary():
                return series.binary(value(n.left), value(n.right), n.op, many(n.on), many(n.ignoring), n.group)
        raise TypeError(f"not an expression: {n!r}")

    return value(node)
