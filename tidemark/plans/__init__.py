"""Composed reports and plan inspection."""

from tidemark.plans import inspect, reports

__all__ = ["inspect", "reports"]
