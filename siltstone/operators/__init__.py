"""The operators, by subject."""

from siltstone.operators import answering, chaos, chunking, evaluation, guardrails, orphans, quality, quantiles, retrieval, telemetry, toolcalls

__all__ = ["answering", "chaos", "chunking", "evaluation", "guardrails", "orphans", "quality", "quantiles", "retrieval", "telemetry", "toolcalls"]
