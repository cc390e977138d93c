"""Column expressions, by subject."""

from siltstone.functions import metrics, models, text, vectors

__all__ = ["metrics", "models", "text", "vectors"]
