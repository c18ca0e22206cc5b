"""The library's own queries over the tables, each with equivalent SQL: imports every module that registers some."""

from __future__ import annotations

from . import analytics, coding, corpora, metering, mining  # noqa: F401
from .coding import split_v4_totals

__all__ = ["split_v4_totals"]
