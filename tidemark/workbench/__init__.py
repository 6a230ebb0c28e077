"""Registered queries over the provided tables."""

from tidemark.workbench import q_features, q_forecast, q_market, q_streams, q_jobs  # noqa: F401
from tidemark.workbench.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
