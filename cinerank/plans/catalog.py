"""Imports every query module so that the registry is complete."""

from cinerank.plans import (q_candidates, q_ctr, q_encoders, q_graph, q_io, q_profiles,  # noqa: F401
                            q_samples, q_streaming, q_vectors)
from cinerank.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
