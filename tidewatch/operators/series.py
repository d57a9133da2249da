"""A time-series algebra on long frames.

Samples are rows (series_key, labels, ts_ms, value); results are rows (series_key,
labels, k, value), with k the step of a grid. Samples aggregate into the pieces
between the ends of windows, and each piece is handed to the windows it belongs to,
so that no series has to fit one process.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.core import series_key


@dataclass(frozen=True)
class Grid:
    """Evaluation steps, in milliseconds, both ends included."""

    start_ms: int
    end_ms: int
    step_ms: int

    @property
    def steps(self) -> int:
        return (self.end_ms - self.start_ms) // self.step_ms + 1 if self.step_ms else 1

    def time_ms(self, k: str = "k") -> Column:
        return F.lit(self.start_ms) + F.col(k) * self.step_ms

    def frame(self, spark) -> DataFrame:
        return spark.range(self.steps).select(F.col("id").cast("int").alias("k"))


def _steps(grid: Grid, back_ms: int, ahead_ms: int) -> Column:
    """The steps whose window [t - back, t + ahead] holds a sample; both ends count."""
    step = max(grid.step_ms, 1)
    first = F.greatest(F.ceil((F.col("ts_ms") - ahead_ms - grid.start_ms) / step), F.lit(0))
    last = F.least(F.floor((F.col("ts_ms") + back_ms - grid.start_ms) / step), F.lit(grid.steps - 1))
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def instant_select(samples: DataFrame, grid: Grid) -> DataFrame:
    """The last sample within half a step around each step; for a single step, within its whole range (5 s at least)."""
    half = grid.step_ms // 2 if grid.steps > 1 else max(grid.end_ms - grid.start_ms, 5000)
    near = samples.where(F.col("ts_ms").between(grid.start_ms - half, grid.end_ms + half))
    rows = near.select("series_key", "labels", "ts_ms", "value", F.explode(_steps(grid, half, half)).alias("k"))
    return rows.groupBy("series_key", "k").agg(F.first("labels").alias("labels"), F.max_by("value", F.struct("ts_ms", "value")).alias("value"))


def instant_at(samples: DataFrame, at_ms: int, lookback_ms: int = 300_000) -> DataFrame:
    """The last sample of each series within a lookback."""
    rows = samples.where(F.col("ts_ms").between(at_ms - lookback_ms, at_ms))
    return rows.groupBy("series_key").agg(F.first("labels").alias("labels"), F.max_by("value", F.struct("ts_ms", "value")).alias("value")).withColumn("k", F.lit(0))


def lookback(*ranges_ms: int) -> int:
    """How far before its grid an expression reads: its longest range, or five minutes if it has none."""
    return max(ranges_ms, default=300_000)


def range_select(samples: DataFrame, grid: Grid, range_ms: int, offset_ms: int = 0) -> DataFrame:
    """Raw samples that any window of the grid can see; ``offset_ms`` looks further back."""
    moved = samples.withColumn("ts_ms", F.col("ts_ms") + offset_ms) if offset_ms else samples
    return moved.where(F.col("ts_ms").between(grid.start_ms - range_ms, grid.end_ms))


def _not_nan(v: str = "value") -> Column:
    return F.when(~F.isnan(v), F.col(v))


def _in_window(name: str) -> Column:
    """What the differences of a window add up to; the first tile's own edge reaches before it."""
    return F.sum(F.col(name) + F.col(f"edge_{name}")) - F.min_by(f"edge_{name}", "tile")


def _differences(v: Column, p: Column, gap: Column) -> dict[str, Column]:
    """A value against the one before it, null if there is none."""
    return {
        "inc": F.when(p.isNull(), 0.0).when(v < p, v).otherwise(v - p), "up": v - p, "gap_ms": gap,
        "changed": F.when(p.isNotNull() & (F.abs(v - p) > 2.220446049250313e-16), 1).otherwise(0), "fell": F.when(p.isNotNull() & (v < p), 1).otherwise(0),
    }


def _merge_moments(a: Column, b: Column) -> Column:
    """Count, mean and squared deviations of two parts together."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = F.when(n > 0, b["n"] / F.nullif(n, F.lit(0.0))).otherwise(0.0)
    return F.struct(n.alias("n"), F.when(b["n"] > 0, a["mean"] + apart * share).otherwise(a["mean"]).alias("mean"), F.when(b["n"] > 0, a["m2"] + b["m2"] + apart * apart * a["n"] * share).otherwise(a["m2"]).alias("m2"))


def _merge_lines(a: Column, b: Column) -> Column:
    """Count, means, squares and products of deviations of two parts together."""
    n, dx, dy = a["n"] + b["n"], b["x"] - a["x"], b["y"] - a["y"]
    share = F.when(n > 0, b["n"] / F.nullif(n, F.lit(0.0))).otherwise(0.0)
    both = lambda own, name: F.when(b["n"] > 0, own).otherwise(a[name]).alias(name)
    weight = a["n"] * share
    return F.struct(n.alias("n"), both(a["x"] + dx * share, "x"), both(a["y"] + dy * share, "y"), both(a["xx"] + b["xx"] + dx * dx * weight, "xx"), both(a["xy"] + b["xy"] + dx * dy * weight, "xy"))


def _merged(part: str, fields: str, merge, finish) -> Column:
    """The parts of a window's tiles, of which there are few, folded into one."""
    zero = F.struct(*(F.lit(0.0).alias(f) for f in fields.split()))
    return F.aggregate(F.collect_list(part), zero, merge, finish)


def _slope(a: Column) -> Column:
    return a["xy"] / F.nullif(a["xx"], F.lit(0.0))


def _functions(origin_ms: int) -> dict:
    """Window functions over tiles: each gets its parameter and gives an aggregate."""
    first, last = lambda f: F.min_by(F.col("first")[f], "tile"), lambda f: F.max_by(F.col("last")[f], "tile")
    n, seconds = lambda: F.sum("n"), lambda: (last("ts_ms") - first("ts_ms")) / 1000.0
    two = lambda c: F.when(n() >= 2, c)
    spread = lambda finish: _merged("moments", "n mean m2", _merge_moments, lambda a: finish(F.when(a["n"] > 0, a["m2"] / F.nullif(a["n"], F.lit(0.0)))))
    line = lambda finish: _merged("line", "n x y xx xy", _merge_lines, finish)
    return {
        "rate": lambda p: F.when((n() >= 2) & (seconds() > 0), _in_window("inc") / F.nullif(seconds(), F.lit(0.0))),
        "irate": lambda p: F.when((n() >= 2) & (last("gap_ms") > 0), last("inc") / F.nullif(last("gap_ms") / 1000.0, F.lit(0.0))),
        "increase": lambda p: F.when((n() >= 2) & (seconds() > 0), _in_window("inc")),
        "sum_over_time": lambda p: F.sum("sum"),
        "avg_over_time": lambda p: F.sum("sum") / F.nullif(F.sum("valued"), F.lit(0)),
        "min_over_time": lambda p: F.min("low"),
        "max_over_time": lambda p: F.max("high"),
        "count_over_time": lambda p: n().cast("double"),
        "stddev_over_time": lambda p: spread(F.sqrt),
        "stdvar_over_time": lambda p: spread(lambda v: v),
        "last_over_time": lambda p: last("value"),
        "first_over_time": lambda p: first("value"),
        "delta": lambda p: two(last("value") - first("value")),
        "idelta": lambda p: two(last("up")),
        "deriv": lambda p: line(_slope),
        "predict_linear": lambda p: line(_slope) * ((last("ts_ms") - origin_ms) / 1000.0 + p) + line(lambda a: a["y"] - _slope(a) * a["x"]),
        "changes": lambda p: _in_window("changed").cast("double"),
        "resets": lambda p: _in_window("fell").cast("double"),
        "present_over_time": lambda p: F.lit(1.0),
    }


RANGE_FUNCTIONS = (*_functions(0), "quantile_over_time", "absent_over_time")
#: Functions whose tiles have plain numbers only, and the way in which tiles add up.
_PLAIN = {"sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "count_over_time", "present_over_time"}
_ADDED = {"n": F.sum, "valued": F.sum, "sum": F.sum, "low": F.min, "high": F.max}
_NEEDS_PREVIOUS = {"rate", "irate", "increase", "idelta", "changes", "resets"}


def _step(grid: Grid, range_ms: int) -> tuple[int, int, int]:
    """A step, and the whole steps and the rest of a range."""
    step = grid.step_ms if grid.steps > 1 else max(range_ms, 1)
    return step, *divmod(range_ms, step)


def _tile(grid: Grid, range_ms: int) -> Column:
    """The tile of a sample.

    Windows end at steps and start a range before them. Tiles are the pieces between all
    those ends, and the ends themselves, since windows hold both of theirs: of each step,
    number 0 is the step, 1 what follows it, 2 the start of a window, 3 the rest.
    """
    step, _, rest = _step(grid, range_ms)
    since = F.col("ts_ms") - grid.start_ms
    into = F.pmod(since, F.lit(step))
    tile = F.floor(since / step) * 4 + F.when(into == 0, 0).when(into < step - rest, 1).when(into == step - rest, 2).otherwise(3)
    return tile.cast("bigint")


def _tiles(rows: DataFrame, grid: Grid, range_ms: int, differences: bool) -> DataFrame:
    """One row for each series and tile, with the parts that window functions merge.

    Differences inside a tile are taken where its samples lie, those between tiles from
    the tiles' ends; so no task has to sort all samples of a series.
    """
    rows = rows.withColumn("tile", _tile(grid, range_ms))
    ends = [F.col("ts_ms"), F.col("value")]
    if differences:
        before = F.lag(F.struct("ts_ms", "value")).over(Window.partitionBy("series_key", "tile").orderBy("ts_ms", "value"))
        rows = rows.withColumn("prev", before)
        rows = rows.withColumns(_differences(F.col("value"), F.col("prev.value"), F.col("ts_ms") - F.col("prev.ts_ms")))
        again = F.coalesce((F.col("gap_ms") == 0) & F.col("value").eqNullSafe(F.col("prev.value")), F.lit(False))  # of equal samples the last one ends the tile
        ends += [again.alias("again"), F.col("prev").isNull().alias("alone"), F.col("inc"), F.col("up"), F.col("gap_ms")]
    x = (F.col("ts_ms") - grid.start_ms) / 1000.0
    n = F.count("value").cast("double")
    m = lambda f: F.coalesce(f, F.lit(0.0))
    parts = [
        F.first("labels").alias("labels"), F.count("*").alias("n"), F.count("value").alias("valued"), F.sum("value").alias("sum"), F.min(_not_nan()).alias("low"), F.max(_not_nan()).alias("high"),
        F.min(F.struct("ts_ms", "value")).alias("first"), F.max(F.struct(*ends)).alias("last"), F.struct(n.alias("n"), m(F.avg("value")).alias("mean"), m(F.var_pop("value") * n).alias("m2")).alias("moments"),
        F.struct(n.alias("n"), m(F.regr_avgx("value", x)).alias("x"), m(F.avg("value")).alias("y"), m(F.regr_sxx("value", x)).alias("xx"), m(F.regr_sxy("value", x)).alias("xy")).alias("line"),
    ]
    if not differences:
        return rows.groupBy("series_key", "tile").agg(*parts)
    sums = ("inc", "changed", "fell")
    tiles = rows.groupBy("series_key", "tile").agg(*parts, *(F.sum(c).alias(c) for c in sums))
    tiles = tiles.withColumn("prev", F.lag("last").over(Window.partitionBy("series_key").orderBy("tile")))
    edge = _differences(F.col("first.value"), F.col("prev.value"), F.col("first.ts_ms") - F.col("prev.ts_ms"))
    own = {c: F.when(F.col("last.alone"), edge[c]).otherwise(F.col("last")[c]).alias(c) for c in ("inc", "up", "gap_ms")}
    return tiles.withColumns({**{f"edge_{c}": edge[c] for c in sums}, "last": F.struct("last.ts_ms", "last.value", *own.values())})


def _plain_tiles(rows: DataFrame, grid: Grid, range_ms: int) -> DataFrame:
    """The tiles of ``_PLAIN`` functions.

    Labels are part of the key at first, so that the aggregate holds numbers alone and each
    task keeps a row a tile; with labels, or the ends of tiles, it would sort all its samples.
    """
    keyed = rows.select("series_key", F.map_entries("labels").alias("entries"), _tile(grid, range_ms).alias("tile"), "value")
    counted = keyed.groupBy("series_key", "entries", "tile").agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.sum("value").alias("sum"), F.min(_not_nan()).alias("low"), F.max(_not_nan()).alias("high"))
    return counted.groupBy("series_key", "tile").agg(F.map_from_entries(F.first("entries")).alias("labels"), *(add(c).alias(c) for c, add in _ADDED.items()))


def _pieces(tiles: DataFrame, grid: Grid, range_ms: int, differences: bool) -> DataFrame:
    """At most two rows for each series and step k, with the parts of the tiles: what its window merges.

    Blocks have as many tiles as a window, so that a window is the end of one block and the
    beginning of the next. Every tile ends one beginning and begins one end of its block; both
    are running totals, and each goes to the steps up to the next tile that is there.
    Deviations are taken from the tile at which a running total begins.
    """
    _, whole, rest = _step(grid, range_ms)
    width = 4 * whole + (2 if rest else 0) + 1
    names, plain = ("inc", "changed", "fell") if differences else (), "moments" not in tiles.columns
    block = Window.partitionBy("series_key", "block")
    orders = {"up": block.orderBy("tile"), "down": block.orderBy(F.desc("tile"))}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = tiles.withColumn("block", F.floor(F.col("tile") / width).cast("bigint"))
    if not plain:
        rows = rows.withColumns({f"{v}_{way}": F.first(c).over(order) for way, order in orders.items() for v, c in (("x", "line.x"), ("y", "moments.mean"))})
    rows = rows.withColumns({f"edge_{c}": zero(F.col(f"edge_{c}")) for c in names})

    def composed(way: str, begins: bool, total, end) -> dict[str, Column]:
        m, x, y = F.col("moments.n"), F.col("line.x") - F.col(f"x_{way}"), F.col("moments.mean") - F.col(f"y_{way}")
        n = F.nullif(total(m), F.lit(0.0))
        dx, dy = total(m * x), total(m * y)
        mean_x, mean_y = zero(F.col(f"x_{way}") + dx / n), zero(F.col(f"y_{way}") + dy / n)
        square = lambda own, a, b, da, db: zero(total(F.col(own) + m * a * b) - da * db / n)
        return {
            "first": end("first", begins), "last": end("last", not begins),
            "moments": F.struct(total(m).alias("n"), mean_y.alias("mean"), F.greatest(square("moments.m2", y, y, dy, dy), F.lit(0.0)).alias("m2")),
            "line": F.struct(total(m).alias("n"), mean_x.alias("x"), mean_y.alias("y"), F.greatest(square("line.xx", x, x, dx, dx), F.lit(0.0)).alias("xx"), square("line.xy", x, y, dx, dy).alias("xy")),
            **{c: total(zero(F.col(c)) + F.col(f"edge_{c}")) - end(f"edge_{c}", begins) for c in names}, **{f"edge_{c}": end(f"edge_{c}", begins) for c in names},
        }

    def piece(way: str) -> Column:
        begins, order = way == "up", orders[way]
        run = order.rowsBetween(Window.unboundedPreceding, 0)
        total = lambda c: F.sum(c).over(run)
        end = lambda c, at_end: F.first(c).over(run) if at_end else F.col(c)
        parts = {**{c: total(c) for c in ("n", "valued", "sum")}, "low": F.min("low").over(run), "high": F.max("high").over(run)}
        if not plain:
            parts |= composed(way, begins, total, end)
        near, start = F.lead("tile").over(order), F.col("block") * width
        if begins:
            low, high = F.ceil(F.col("tile") / 4), F.floor((F.coalesce(near, start + width) - 1) / 4)
        else:
            low, high = F.ceil((F.coalesce(near, start) + width) / 4), F.floor((F.col("tile") + width - 1) / 4)
        low, high = F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(grid.steps - 1)).cast("int")
        steps = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.struct(steps.alias("steps"), (F.col("block") * 2 + (0 if begins else 1)).alias("tile"), *(v.alias(k) for k, v in parts.items()))

    both = rows.select("series_key", "labels", piece("up").alias("up"), piece("down").alias("down")).select("series_key", "labels", F.explode(F.array("up", "down")).alias("p"))
    return both.select("series_key", "labels", "p.*").withColumn("k", F.explode("steps")).drop("steps")


def range_functions(samples: DataFrame, grid: Grid, range_ms: int, wanted: dict[str, float | None]) -> DataFrame:
    """(series_key, labels, k, <one column a function>) over sliding windows [t - range, t].

    Samples are added up in tiles first, at most four a step, tiles in running totals of
    blocks, and a window is merged from two of those, whatever its range; only quantiles copy
    samples into all their windows. Null where a function has too few samples.
    """
    rows = range_select(samples, grid, range_ms).select("series_key", "labels", "ts_ms", "value")
    known = _functions(grid.start_ms)
    merged = {f: p for f, p in wanted.items() if f in known}
    outs = []
    if merged:
        differences = bool(_NEEDS_PREVIOUS & set(merged))
        tiles = _plain_tiles(rows, grid, range_ms) if set(merged) <= _PLAIN else _tiles(rows, grid, range_ms, differences)
        pieces = _pieces(tiles, grid, range_ms, differences)
        outs.append(pieces.groupBy("series_key", "k").agg(F.first("labels").alias("labels"), *(known[f](p).alias(f) for f, p in merged.items())))
    if "quantile_over_time" in wanted:
        point = min(max(wanted["quantile_over_time"], 0.0), 1.0)
        copies = rows.withColumn("k", F.explode(_steps(grid, range_ms, 0)))
        quantiles = copies.groupBy("series_key", "k").agg(F.first("labels").alias("labels"), F.percentile("value", point).alias("quantile_over_time"))
        outs.append(quantiles.drop("labels") if merged else quantiles)
    joined = reduce(lambda a, b: a.join(b, ["series_key", "k"]), outs)
    return joined.select("series_key", "k", "labels", *wanted)


def range_function(samples: DataFrame, grid: Grid, range_ms: int, name: str, param: float | None = None) -> DataFrame:
    """(series_key, labels, k, value) of one function; windows without a result are left out."""
    if name == "absent_over_time":
        return absent_over_time(samples, grid, range_ms)
    out = range_functions(samples, grid, range_ms, {name: param})
    return out.withColumnRenamed(name, "value").where("value IS NOT NULL")


def absent_over_time(samples: DataFrame, grid: Grid, range_ms: int) -> DataFrame:
    """1 at the steps where a known series has an empty window."""
    seen = range_select(samples, grid, range_ms).select("series_key", F.explode(_steps(grid, range_ms, 0)).alias("k")).distinct()
    series = samples.groupBy("series_key").agg(F.first("labels").alias("labels"))
    every = series.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(grid.steps - 1))))
    return every.join(seen, ["series_key", "k"], "left_anti").withColumn("value", F.lit(1.0))


def merge_series(*frames: DataFrame) -> DataFrame:
    """Samples of several tables; equal label sets become one series."""
    return reduce(DataFrame.unionByName, frames)


def constant(spark, grid: Grid, value: float) -> DataFrame:
    """A number at every step, as a series without labels."""
    labels = F.create_map().cast("map<string,string>")
    return grid.frame(spark).select(F.lit("{}").alias("series_key"), labels.alias("labels"), "k", F.lit(float(value)).alias("value"))


# ------------------------------------------------------------ across series


def group_labels(by: list[str] | None = None, without: list[str] | None = None) -> Column:
    """The labels a result keeps: those of ``by``, all but ``without``, or none."""
    if by is not None:
        return F.map_filter("labels", lambda k, v: k.isin(by) if by else F.lit(False))
    if without is not None:
        return F.map_filter("labels", lambda k, v: ~k.isin([*without, "__name__"]))
    return F.create_map().cast("map<string,string>")


_ACROSS = {
    "sum": lambda p: F.sum("value"), "avg": lambda p: F.avg("value"), "min": lambda p: F.min(_not_nan()), "max": lambda p: F.max(_not_nan()), "count": lambda p: F.count("*").cast("double"),
    "stddev": lambda p: F.stddev_pop("value"), "stdvar": lambda p: F.var_pop("value"), "quantile": lambda p: F.percentile("value", min(max(p, 0.0), 1.0)), "group": lambda p: F.lit(1.0),
    "count_values": lambda p: F.countDistinct(F.floor(F.col("value") * 1e6)).cast("double"),
}
AGGREGATIONS = (*_ACROSS, "topk", "bottomk")


def aggregate(series: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None, param: float | None = None) -> DataFrame:
    """Aggregate series at each step; ``topk`` and ``bottomk`` keep whole series by their latest value."""
    kept = group_labels(by, without)
    if op in ("topk", "bottomk"):
        return _ranked(series, op, kept, int(param or 1))
    grouped = series.withColumn("_g", kept).withColumn("_key", series_key("_g")).groupBy("_key", "k").agg(F.first("_g").alias("labels"), _ACROSS[op](param).alias("value"))
    return grouped.select(F.col("_key").alias("series_key"), "labels", "k", "value")


def _ranked(series: DataFrame, op: str, kept: Column, n: int) -> DataFrame:
    latest = series.withColumn("_key", series_key(kept)).groupBy("series_key").agg(F.first("_key").alias("_key"), F.max_by("value", "k").alias("_last"))
    order = F.desc("_last") if op == "topk" else F.asc("_last")
    best = latest.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(order, "series_key"))).where(F.col("_n") <= n)
    return series.join(best.select("series_key"), "series_key", "left_semi").select("series_key", "labels", "k", "value")


# ----------------------------------------------------------- scalar functions


def _log(f) -> Column:
    v = F.col("value")
    return F.when(v > 0, f(F.when(v > 0, v))).when(v == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def _round_to(to: float) -> Column:
    """Nearest multiple, halves away from zero."""
    return F.col("value") if to == 0 else F.round(F.col("value") / to) * to


def _bound(low: float | None, high: float | None) -> Column:
    """Clamp; a value that is no number becomes the bound."""
    if low is not None and high is not None and low > high:
        raise ValueError("the lower bound is over the upper one")
    v = F.col("value")
    out = F.when(F.isnan(v), F.lit(low if low is not None else high)).otherwise(v)
    out = F.greatest(out, F.lit(low)) if low is not None else out
    return F.least(out, F.lit(high)) if high is not None else out


_SCALAR = {
    "abs": lambda: F.abs("value"), "ceil": lambda: F.ceil("value").cast("double"), "floor": lambda: F.floor("value").cast("double"), "round": lambda to=1.0: _round_to(to), "sqrt": lambda: F.sqrt("value"), "exp": lambda: F.exp("value"),
    "ln": lambda: _log(F.ln), "log2": lambda: _log(F.log2), "log10": lambda: _log(F.log10), "sgn": lambda: F.when(F.isnan("value"), 0.0).when(F.col("value") > 0, 1.0).when(F.col("value") < 0, -1.0).otherwise(0.0),
    "clamp_min": lambda low: _bound(low, None), "clamp_max": lambda high: _bound(None, high), "clamp": lambda low, high: _bound(low, high),
    "sin": lambda: F.sin("value"), "cos": lambda: F.cos("value"), "asin": lambda: F.asin("value"), "acos": lambda: F.acos("value"), "atan2": lambda other=0.0: F.atan2(F.col("value"), F.lit(other)), "sinh": lambda: F.sinh("value"), "cosh": lambda: F.cosh("value"),
    "asinh": lambda: F.asinh("value"), "acosh": lambda: F.acosh("value"), "atanh": lambda: F.atanh("value"), "deg": lambda: F.degrees("value"), "rad": lambda: F.radians("value"), "pi": lambda: F.pi(), "neg": lambda: -F.col("value"),
}
SCALAR_FUNCTIONS = (*_SCALAR, "timestamp")


def scalar(series: DataFrame, name: str, *args: float, grid: Grid | None = None) -> DataFrame:
    """Apply a function to every value. ``timestamp`` gives the time of the step in seconds."""
    value = grid.time_ms() / 1000.0 if name == "timestamp" else _SCALAR[name](*args)
    return series.withColumn("value", value)


def histogram_quantile(series: DataFrame, phi: float, last_only: bool = False) -> DataFrame:
    """Quantile of cumulative buckets with an ``le`` label, linear within a bucket, at each step.

    Series group by their labels without ``le`` and the name. An empty histogram gives
    no row. ``last_only`` keeps the last step alone.
    """
    le = F.when(F.col("labels")["le"] == "+Inf", F.lit(float("inf"))).otherwise(F.coalesce(F.col("labels")["le"].try_cast("double"), F.lit(0.0)))
    rest = F.map_filter("labels", lambda k, v: ~k.isin("le", "__name__"))
    rows = series.select(rest.alias("labels"), le.alias("le"), "k", "value").withColumn("series_key", series_key("labels"))
    if last_only:
        rows = rows.groupBy("series_key", "le").agg(F.first("labels").alias("labels"), F.max_by("value", "k").alias("value"), F.max("k").alias("k")).withColumn("k", F.max("k").over(Window.partitionBy("series_key")))
    grouped = rows.groupBy("series_key", "k").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("le", F.col("value").alias("n")))).alias("b"))
    target = F.element_at("b", -1)["n"] * phi
    start = F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("out"))

    def step(acc: Column, bucket: Column) -> Column:
        width = bucket["n"] - acc["n"]
        inside = F.when(width > 0, acc["le"] + (bucket["le"] - acc["le"]) * (target - acc["n"]) / F.nullif(width, F.lit(0.0))).otherwise(acc["le"])
        found = acc["out"].isNull() & (bucket["n"] >= target)
        return F.struct(bucket["le"].alias("le"), bucket["n"].alias("n"), F.when(found, inside).otherwise(acc["out"]).alias("out"))

    value = F.aggregate("b", start, step, lambda a: F.coalesce(a["out"], F.lit(float("nan"))))
    return grouped.where(F.element_at("b", -1)["n"] != 0).select("series_key", "labels", "k", value.alias("value"))


# ------------------------------------------------------------ binary operators

def _nan() -> Column:
    return F.lit(float("nan"))


_ARITHMETIC = {
    "+": lambda l, r: l + r, "-": lambda l, r: l - r, "*": lambda l, r: l * r, "/": lambda l, r: F.when(r == 0, _nan()).otherwise(l / F.nullif(r, F.lit(0.0))),
    "%": lambda l, r: F.when(r == 0, _nan()).otherwise(l % F.nullif(r, F.lit(0.0))), "^": lambda l, r: F.pow(l, r),
}
_COMPARISON = {"==": lambda l, r: l == r, "!=": lambda l, r: l != r, "<": lambda l, r: l < r, ">": lambda l, r: l > r, "<=": lambda l, r: l <= r, ">=": lambda l, r: l >= r}
BINARY_OPERATORS = (*_ARITHMETIC, *_COMPARISON)


def _apply(df: DataFrame, op: str, left: Column, right: Column, as_bool: bool) -> DataFrame:
    """Set ``value``; a plain comparison keeps the rows where it holds, with the left value.

    Comparisons are those of IEEE numbers: with NaN only ``!=`` holds.
    """
    if op in _ARITHMETIC:
        return df.withColumn("value", _ARITHMETIC[op](left, right))
    nan = F.isnan(left) | F.isnan(right)
    holds = F.when(nan, F.lit(op == "!=")).otherwise(_COMPARISON[op](left, right))
    return df.withColumn("value", F.when(holds, 1.0).otherwise(0.0)) if as_bool else df.where(holds).withColumn("value", left)


def with_scalar(series: DataFrame, op: str, number: float, scalar_left: bool = False, as_bool: bool = False) -> DataFrame:
    v, n = F.col("value"), F.lit(float(number))
    return _apply(series, op, *((n, v) if scalar_left else (v, n)), as_bool)


def with_steps(series: DataFrame, op: str, steps: DataFrame, as_bool: bool = False) -> DataFrame:
    """Combine each series with a one-series frame, step by step; the grid bounds its size."""
    one = steps.select("k", F.col("value").alias("_r"))
    return _apply(series.join(F.broadcast(one), "k"), op, F.col("value"), F.col("_r"), as_bool).drop("_r")


def match_key(on: list[str] | None = None, ignoring: list[str] | None = None) -> Column:
    """Canonical text of the labels that two series must share; names never count."""
    if on is not None:
        return series_key(F.map_filter("labels", lambda k, v: k.isin(on) if on else F.lit(False)))
    return series_key(F.map_filter("labels", lambda k, v: ~k.isin([*(ignoring or []), "__name__"])))


def binary(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None, group: str | None = None, include: list[str] = (), as_bool: bool = False) -> DataFrame:
    """Match series by labels and combine them at equal steps.

    ``group`` ``left`` or ``right`` names the side of the many, whose labels the result
    keeps, with the ``include`` labels of the other side. Otherwise it keeps the
    matched labels.
    """
    key = match_key(on, ignoring)
    l = left.select(key.alias("_m"), "k", F.col("labels").alias("_ll"), F.col("value").alias("_l"))
    r = right.select(key.alias("_m"), "k", F.col("labels").alias("_rl"), F.col("value").alias("_r"))
    many, one = ("_rl", "_ll") if group == "right" else ("_ll", "_rl")
    own = F.map_filter(many, lambda k, v: k != "__name__")
    if group:
        extra = F.map_filter(one, lambda k, v: k.isin(list(include)) if include else F.lit(False))
        labels = F.map_concat(F.map_filter(own, lambda k, v: ~k.isin(list(include)) if include else F.lit(True)), extra)
    elif on is not None:
        labels = F.map_filter(own, lambda k, v: k.isin(on) if on else F.lit(False))
    else:
        labels = F.map_filter(own, lambda k, v: ~k.isin(list(ignoring)) if ignoring else F.lit(True))
    joined = l.join(r, ["_m", "k"]).withColumn("labels", labels)
    out = _apply(joined, op, F.col("_l"), F.col("_r"), as_bool)
    return out.select(series_key("labels").alias("series_key"), "labels", "k", "value")


def set_operation(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    """``and``, ``unless`` and ``or`` of whole series by their matched labels."""
    key = match_key(on, ignoring)
    columns = ["series_key", "labels", "k", "value"]
    l, r = left.select(*columns, key.alias("_m")), right.select(*columns, key.alias("_m"))
    if op == "or":
        return l.select(*columns).unionByName(r.join(l.select("_m").distinct(), "_m", "left_anti").select(*columns))
    kind = {"and": "left_semi", "unless": "left_anti"}[op]
    return l.join(r.select("_m").distinct(), "_m", kind).select(*columns)
