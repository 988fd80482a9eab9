"""Registered queries, by family. Importing this package registers all of them."""

from barline.plans import bars, boosted, deliveries, extras, features, joins, more, portfolios, research, signals, spread, streams
from barline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bars", "boosted", "deliveries", "extras", "features", "joins", "more", "portfolios", "research", "signals", "spread", "streams"]
