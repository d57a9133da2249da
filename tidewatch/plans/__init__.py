"""Registered queries: one module per area, each with ``QUERIES`` and ``ORACLES``."""
