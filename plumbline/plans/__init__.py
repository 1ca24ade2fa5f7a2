"""Runnable queries over the given tables."""

import importlib

from plumbline.plans.registry import ORACLES, QUERIES

# bids first: it names the priced-line tables the other oracles build on
MODULES = ["bids", "quality", "search", "edits", "metering", "plantext", "accuracy", "graph", "geometry", "rooms", "zones", "commands"]
for _module in MODULES:
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
