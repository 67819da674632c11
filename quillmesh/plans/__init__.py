"""Registered queries over the driver tables, each next to its SQL check."""

from __future__ import annotations

from . import corpus, items, records, search, sources, store, tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
