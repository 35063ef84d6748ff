"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from catalogue import (  # noqa: F401  (importing registers the queries)
    alerting, charting, cleaning, describing, exploring, figures, files, modelling, profiling,
    trends)
from catalogue.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
