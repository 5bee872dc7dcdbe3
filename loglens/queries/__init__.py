"""Registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from . import advanced, analytics, basic

QUERIES: dict = {**basic.Q, **analytics.Q, **advanced.Q}
ORACLES: dict[str, str] = {**basic.O, **analytics.O, **advanced.O}
