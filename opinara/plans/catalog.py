"""Imports every module that registers queries."""

from __future__ import annotations

from . import core, forecasting, language, models, monitoring, reports, search  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
