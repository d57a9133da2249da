"""The states of threshold monitors, as maps that compose.

A value, whatever it is, takes each of the four states to one of the four. Such a map is one
number of eight bits, and maps compose associatively: long histories are composed in tiles,
tiles in larger tiles, and only then is the state that a group begins with put in.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.core import materialize

STATES = ("ok", "no_data", "warn", "alert")
#: Rows of a tile, as a power of two.
TILE_BITS = 8


def _map(**to: str) -> int:
    return sum(STATES.index(to[state]) << 2 * i for i, state in enumerate(STATES))


def _after(over_critical: bool, over_warning: bool, under_critical: bool, under_warning: bool) -> int:
    """The map of a value over or not over the two limits, and back or not back under what ends each state."""
    calm = "alert" if over_critical else "warn" if over_warning else "ok"
    warned = "alert" if over_critical else "ok" if under_warning else "warn"
    return _map(ok=calm, no_data=calm, warn=warned, alert="alert" if not under_critical else "warn" if over_warning else "ok")


#: All maps of values, by four bits: over critical, over warning, back from critical, back from warning.
TRANSITIONS = [_after(*(bool(bits >> b & 1) for b in range(4))) for bits in range(16)]
#: Maps of a tick without data, by what the rule does then.
MISSING = {"resolve": _map(ok="ok", no_data="ok", warn="ok", alert="ok"), "notify": _map(ok="no_data", no_data="no_data", warn="no_data", alert="no_data")}
SAME = _map(**{s: s for s in STATES})


def step(value: Column, critical: Column, critical_recovery: Column, warning: Column, warning_recovery: Column, comparator: Column, no_data_action: Column | None = None) -> Column:
    """The map of one value. Null limits are unset; a state ends where the value is back under its
    recovery limit, or under the limit itself. With an action, null and NaN are ticks without data."""
    over = lambda limit: F.when(comparator == "below", value < limit).otherwise(value >= limit)
    true = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    tests = [over(critical), over(warning), ~over(F.coalesce(critical_recovery, critical)), ~over(F.coalesce(warning_recovery, warning))]
    found = F.element_at(F.array(*map(F.lit, TRANSITIONS)), reduce(add, (true(t) * (1 << b) for b, t in enumerate(tests))) + 1)
    if no_data_action is None:
        return found
    gone = F.when(no_data_action == "resolve", MISSING["resolve"]).otherwise(MISSING["notify"])
    return F.when(value.isNull() | F.isnan(value), gone).otherwise(found)


def state_after(state: str, value: float, critical: float | None, critical_recovery: float | None, warning: float | None, warning_recovery: float | None, comparator: str = "above") -> str:
    """The state after one value, from the same table, for streams."""
    over = lambda limit: limit is not None and (value < limit if comparator == "below" else value >= limit)
    back = lambda limit: limit is not None and not over(limit)
    first = lambda a, b: b if a is None else a
    tests = (over(critical), over(warning), back(first(critical_recovery, critical)), back(first(warning_recovery, warning)))
    code = TRANSITIONS[sum(t << b for b, t in enumerate(tests))]
    return STATES[code >> 2 * STATES.index(state) & 3] if state in STATES else "ok"


def applied(code: Column, state: Column) -> Column:
    """The state that a map gives; ``ok`` for a state that is none of the four."""
    number = reduce(lambda a, i: a.when(state == STATES[i], i), range(1, 4), F.when(state == STATES[0], 0))
    to = F.call_function("shiftright", code, number * 2).bitwiseAND(3)
    return F.coalesce(F.get(F.array(*map(F.lit, STATES)), to), F.lit("ok"))


def then(first: Column, second: Column) -> Column:
    """The map of two maps, one after the other."""
    through = lambda i: F.call_function("shiftright", second, F.shiftright(first, 2 * i).bitwiseAND(3) * 2).bitwiseAND(3)
    return reduce(add, (through(i) * (1 << 2 * i) for i in range(4)))


def _prefixes(codes: Column) -> Column:
    """The maps of no, one, two and more codes of an array, one longer than it."""
    return F.aggregate(codes, F.array(F.lit(SAME)), lambda seen, code: F.concat(seen, F.array(then(F.element_at(seen, -1), code))))


def _before(rows: DataFrame, levels: int) -> DataFrame:
    """(g, id, before): the map of all earlier rows of a group, for rows (g, id, code) in order of ``id``."""
    id_ = F.shiftright("id", TILE_BITS) if levels else F.lit(0).cast("bigint")
    tiles = rows.groupBy("g", id_.alias("tile")).agg(F.array_sort(F.collect_list(F.struct("id", "code"))).alias("own"))
    tiles = tiles.withColumn("maps", _prefixes(F.col("own.code")))
    if levels:
        # row numbers come from a stored table, so that both readings of it agree
        starts = _before(tiles.select("g", F.col("tile").alias("id"), F.element_at("maps", -1).alias("code")), levels - 1).withColumnRenamed("id", "tile")
        tiles = tiles.join(starts, ["g", "tile"])
    else:
        tiles = tiles.withColumn("before", F.lit(SAME))
    each = tiles.select("g", "before", F.explode(F.arrays_zip(F.col("own.id").alias("id"), F.slice("maps", 1, F.size("own")).alias("map"))).alias("row"))
    return each.select("g", F.col("row.id").alias("id"), then(F.col("before"), F.col("row.map")).alias("before"))


def replay(values: DataFrame, thresholds: dict, keys: list[str], order: str, no_data_action: str = "notify", initial: str = "ok") -> DataFrame:
    """(keys, order, value, state): the states of each group over its ordered values.

    Equal orders go by value: null first, NaN last. A null or NaN value is without data. Rows
    are dealt by ranges of group and order, so that a long group has many tasks; tiles of 256
    rows and of 256 tiles are composed where they are, and one row for 65,536 of a group's meets in one task.
    """
    limits = [F.lit(thresholds.get(k)).cast("double") for k in ("critical", "critical_recovery", "warning", "warning_recovery")]
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("one"))
    value = F.col("value").cast("double")
    code = step(value, *limits, F.lit(thresholds.get("comparator", "above")), F.lit(no_data_action))
    rows = values.select(group.alias("g"), F.col(order).alias("at"), value.alias("value"), code.alias("code"))
    placed = rows.repartitionByRange("g", "at", "value").sortWithinPartitions("g", "at", "value").withColumn("id", F.monotonically_increasing_id())
    stored = materialize(placed, "monitor-values")
    started = stored.join(_before(stored.select("g", "id", "code"), 2), ["g", "id"])
    state = applied(then(F.col("before"), F.col("code")), F.lit(initial))
    return started.select(*(F.col(f"g.{k}").alias(k) for k in keys), F.col("at").alias(order), "value", state.alias("state"))
