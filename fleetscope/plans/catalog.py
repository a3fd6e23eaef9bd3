"""All registered queries of the engine."""

from __future__ import annotations

from fleetscope.plans import calibration, cleaning, evaluation, federated, files, learned, live, models, relational, sweeps  # noqa: F401  registers their queries
from fleetscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
