"""The registered queries over the driver's tables."""

from . import analysis, decisions, digests, features, flow, membership, mergers, panel, pit, research, reviews, series, trades, zones
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis", "decisions", "digests", "features", "flow", "membership", "mergers", "panel", "pit", "research", "reviews", "series", "trades", "zones"]
