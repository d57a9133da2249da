"""All queries of the telemetry library, and their SQL twins."""

from __future__ import annotations

from tidewatch.plans import jobs, metrics, monitors, rules, traces, wire

_AREAS = (traces, metrics, rules, monitors, jobs, wire)
QUERIES: dict = {k: v for area in _AREAS for k, v in area.QUERIES.items()}
ORACLES: dict = {k: v for area in _AREAS for k, v in area.ORACLES.items()}
