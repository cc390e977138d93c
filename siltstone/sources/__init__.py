"""Reading and writing."""

from siltstone.sources import files, logs, store

__all__ = ["files", "logs", "store"]
