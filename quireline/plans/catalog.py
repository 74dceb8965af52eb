"""All queries on the driver's tables by name."""

from __future__ import annotations

from . import evaluation, judging, selection, sequences, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
