"""The registered queries."""

from . import blocks, codecs, segments, state
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "blocks", "codecs", "segments", "state"]
