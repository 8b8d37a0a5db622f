"""All registered queries; importing this package registers them."""

from vigil.plans.queries import extract, history, places, series, text, views
from vigil.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "extract", "history", "places", "series", "text", "views"]
