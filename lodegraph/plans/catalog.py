"""Imports the modules that register queries."""

from . import code, graphs, history, links, review, rules, streams

__all__ = ["code", "graphs", "history", "links", "review", "rules", "streams"]
