"""All registered queries and their SQL."""

from . import curation_queries, flow_queries, glyph_queries  # noqa: F401  they register queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
