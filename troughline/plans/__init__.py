"""Registered queries, loaded on import."""

from troughline.plans import events, inventory, raters, sampling_plans, source_plans  # noqa: F401
from troughline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
