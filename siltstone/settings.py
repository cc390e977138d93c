"""Settings of a pipeline, with their defaults, read from the environment where it names them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """chunk_size, chunk_overlap: characters. top_k: results. rrf: constant of the rank fusion. threshold: dense score below which a query falls back."""

    chunk_size: int = 500
    chunk_overlap: int = 50
    chunk_strategy: str = "recursive"
    top_k: int = 5
    rrf: int = 60
    threshold: float = 0.35
    min_score: float = 0.0
    dimensions: int = 64

    @classmethod
    def read(cls, environment: Mapping[str, str] | None = None, prefix: str = "SILTSTONE_") -> Settings:
        """Each field from PREFIX_FIELD if it is there and not blank; a value that can't be read as the field's type is an error that names it."""
        env = os.environ if environment is None else environment
        given = {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper(), "").strip()
            if text:
                try:
                    given[f.name] = type(f.default)(text)
                except ValueError as e:
                    raise ValueError(f"{prefix}{f.name.upper()}: {text!r} is no {type(f.default).__name__}") from e
        return cls(**given)
