"""Streaming forms of the log operators."""

from siltstone.streaming import operators

__all__ = ["operators"]
