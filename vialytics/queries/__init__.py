"""The registered queries over the test tables."""

from . import analytics, embeddings, figures, identity, lists, matching, observations, phrases, plates, quality, recovery, reports, selection, streams, tracklets, transitions
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "embeddings", "figures", "identity", "lists", "matching", "observations", "phrases", "plates", "quality", "recovery", "reports", "selection", "streams", "tracklets", "transitions"]
