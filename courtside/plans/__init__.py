"""Registered queries: every operator run over whole tables, with an independent SQL oracle."""

from courtside.plans import alerts, archive, feed, history, linkage, rankings, sources, streams, text  # noqa: F401
from courtside.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
