"""Queries exposed to the driver, each with its SQL twin where SQL can express it."""

from . import cleaning, files, loads, marts, models, profiles, relations, reports, resolution  # noqa: F401
from .core import oracles, queries

__all__ = ["oracles", "queries"]
