"""Queries over the reference's operators and their SQL."""

from __future__ import annotations

from locuskit.plans import audits, cards, decisions, evidence, export, inputs, public, release, selection, streams, structure, summaries  # noqa: F401
from locuskit.plans.registry import ORACLES, QUERIES

FLAGSHIP = "a07_model_junction_support"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
