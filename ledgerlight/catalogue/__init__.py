"""The registered queries for the engine's own operators."""

from . import documents, relational, retrieval, rules, streams, texts, web  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
