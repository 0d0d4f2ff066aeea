"""Import every query module so that the registry is complete."""

from . import q_clones, q_features, q_flows, q_metrics, q_models, q_public, q_review, q_splits  # noqa: F401
from .registry import QUERIES, oracles

ORACLES = oracles()
