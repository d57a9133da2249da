"""Filters and text search as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.core import attr, non_empty, normalize_status

SPAN_COLUMNS = "trace_id span_id parent_span_id service_name span_name kind status duration_ns http_method http_path http_status_code".split()
LOG_COLUMNS = "trace_id span_id severity_text severity_number body service_name event_name scope_name".split()
RUM_COLUMNS = (
    "app_name app_version environment session_id user_id page_url page_path view_name referrer browser_name browser_version os_name os_version "
    "device_type event_type event_name vital_name vital_value vital_rating error_message error_type interaction_target interaction_type duration_ms trace_id span_id"
).split()
METRIC_COLUMNS = "metric_name service_name metric_unit value".split()


def span_field(name: str) -> Column:
    """A span column, ``level`` for the status in lower case, or ``attributes.key``; others are null.

    A key with dots is looked up whole first; where it is missing, its parts lead into the
    JSON that the attribute of the first part holds.
    """
    if name == "level":
        return F.lower("status")
    if name.startswith("attributes."):
        key = name.removeprefix("attributes.")
        top, *path = key.split(".")
        if not path or "'" in key:
            return attr("attributes", key)
        return non_empty(attr("attributes", key), F.get_json_object(attr("attributes", top), "$" + "".join(f"['{p}']" for p in path)))
    return F.col(name) if name in SPAN_COLUMNS else F.lit(None).cast("string")


def log_field(name: str) -> Column:
    """A log column, ``resource.key``, ``log.key`` or ``attributes.key``; a bare key reads log, then resource attributes."""
    if name in LOG_COLUMNS:
        return F.col(name)
    for prefix, source in (("resource.", "resource_attributes"), ("log.", "log_attributes"), ("attributes.", "log_attributes")):
        if name.startswith(prefix):
            return attr(source, name.removeprefix(prefix))
    return non_empty(attr("log_attributes", name), attr("resource_attributes", name))


def metric_field(name: str) -> Column:
    return F.col(name) if name in METRIC_COLUMNS else attr("attributes", name.removeprefix("attributes."))


def rum_field(name: str) -> Column:
    """A browser-event column in snake or Pascal case, else an attribute."""
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    return F.col(snake) if snake in RUM_COLUMNS else attr("attributes", name.removeprefix("attributes."))


def _literal(value) -> Column:
    if isinstance(value, bool):
        return F.lit(int(value))
    return F.lit(value if isinstance(value, (str, int, float)) else "")


def _typed(field: Column, value) -> tuple[Column, Column]:
    """Both sides on one type: numbers compare as numbers, everything else as text."""
    if isinstance(value, (int, float)):
        return field.try_cast("double"), _literal(value).cast("double")
    return field.cast("string"), _literal(value)


def as_list(value) -> list:
    """The members of an IN list, given as a list or as text with commas."""
    return [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value)


def compare(field: Column, op: str, value) -> Column:
    op = op.upper()
    if op in ("IN", "NOT IN"):
        members = as_list(value)
        inside = field.cast("string").isin([str(int(v)) if isinstance(v, bool) else str(v) for v in members]) if members else F.lit(False)
        return inside if op == "IN" else ~inside
    if op in ("LIKE", "NOT LIKE"):
        match = field.cast("string").like(str(value))
        return match if op == "LIKE" else ~match
    left, right = _typed(field, value)
    return {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def where(filters: list[tuple], resolve: Callable[[str], Column] = span_field) -> Column:
    """Conjunction of (field, op, value) filters."""
    return reduce(lambda a, b: a & b, (compare(resolve(f), op, v) for f, op, v in filters), F.lit(True))


def between(start, end, ts: str = "ts") -> Column:
    return F.col(ts).between(F.lit(start), F.lit(end))


def between_seconds(start, end, ts: str = "ts") -> Column:
    """Inclusive range at whole seconds, as metric queries use."""
    return F.date_trunc("second", F.col(ts)).between(F.date_trunc("second", F.lit(start).cast("timestamp")), F.date_trunc("second", F.lit(end).cast("timestamp")))


def span_blob() -> Column:
    """All attribute texts of a span and its events, in lower case."""
    return F.lower(F.concat_ws(" ", F.to_json("attributes"), F.array_join(F.coalesce("event_attributes", F.array().cast("array<string>")), " ")))


def _pattern(term: str) -> str:
    escaped = term.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return "%" + escaped.replace("*", "%") + "%"


def id_lookup(term: str) -> Column | None:
    """Equality on the trace or span id where the term is one."""
    if re.fullmatch("[0-9a-fA-F]{32}", term):
        return F.col("trace_id") == term.lower()
    if re.fullmatch("[0-9a-fA-F]{16}", term):
        return F.col("span_id") == term.lower()
    return None


def key_value(term: str, maps: list[str]) -> Column | None:
    """``key=value`` on attribute maps; ``*`` in the value is a wildcard."""
    if not (m := re.fullmatch(r"([\w.\-]+)=(.+)", term)):
        return None
    key, value = m.groups()
    fields = [attr(name, key) for name in maps]
    tests = [f.ilike(value.replace("%", "\\%").replace("_", "\\_").replace("*", "%")) if "*" in value else f == value for f in fields]
    return reduce(lambda a, b: a | b, tests)


def text_search(any_of: list[list[str]], columns: list[Column], maps: list[str]) -> Column:
    """OR over groups of terms that must all be found, case-insensitively, in some column.

    A group is a list; ``[["timeout", "gateway"], ["oom*killed"]]`` is (timeout and
    gateway) or oom...killed. Ids and ``key=value`` terms are looked up exactly.
    """
    def term(text: str) -> Column:
        exact = id_lookup(text)
        if exact is None:
            exact = key_value(text, maps)
        return exact if exact is not None else reduce(lambda a, b: a | b, (F.lower(c).like(_pattern(text)) for c in columns))

    groups = [reduce(lambda a, b: a & b, map(term, group)) for group in any_of if group]
    return reduce(lambda a, b: a | b, groups) if groups else F.lit(True)


def span_search(any_of: list[list[str]]) -> Column:
    return text_search(any_of, [F.col("service_name"), F.col("span_name"), F.col("http_path"), span_blob()], ["attributes"])


def log_search(any_of: list[list[str]]) -> Column:
    return text_search(any_of, [F.col("body"), F.col("service_name"), F.col("severity_text")], ["log_attributes", "resource_attributes"])


def has_tokens(text: str | Column, search: str) -> Column:
    """Every white-space separated token of ``search`` is a whole token of the text."""
    tokens = F.split(F.lower(text), "[^a-z0-9]+")
    return reduce(lambda a, b: a & b, (F.array_contains(tokens, t) for t in search.lower().split()), F.lit(True))


def label_matchers(matchers: list[tuple[str, str, str]], anchored: bool = False) -> Column:
    """``= != =~ !~`` on labels; a missing label is empty. Name and service have columns of their own."""
    columns = {"__name__": F.col("metric_name"), "job": F.col("service_name"), "service_name": F.col("service_name")}

    def one(label: str, op: str, value: str) -> Column:
        field = columns.get(label, attr("attributes", label))
        if op in ("=", "!="):
            return field == value if op == "=" else field != value
        found = field.rlike(f"^(?:{value})$" if anchored else value)
        return found if op == "=~" else ~found

    return reduce(lambda a, b: a & b, (one(*m) for m in matchers), F.lit(True))


def prefix(column: str, start: str) -> Column:
    return F.col(column).startswith(start) if start else F.lit(True)


def funnel_step(service: str | None = None, path_prefix: str | None = None, status_min: int | None = None, status_max: int | None = None) -> Column:
    tests = [
        F.col("service_name") == service if service else None,
        F.col("http_path").startswith(path_prefix) if path_prefix else None,
        F.col("http_status_code") >= status_min if status_min is not None else None,
        F.col("http_status_code") <= status_max if status_max is not None else None,
    ]
    return reduce(lambda a, b: a & b, (t for t in tests if t is not None), F.lit(True))


def before(cursor: tuple[int, str], ts: str = "ts_ns", key: str = "span_id") -> Column:
    """Strictly before a (time, id) cursor in newest-first order."""
    at, name = cursor
    return (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < name))
