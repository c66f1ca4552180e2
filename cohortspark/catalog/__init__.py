"""Registered queries over the checker's tables."""

from cohortspark.catalog.registry import ORACLES, QUERIES
from cohortspark.catalog import cohort, encoding, events, features, fidelity, privacy, storage, utility  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
