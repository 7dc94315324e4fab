"""All registered queries of the engine's own operators."""

from . import composed, lines, models, more
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "composed", "lines", "models", "more"]
