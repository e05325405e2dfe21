"""Queries over the test tables, each with its SQL where SQL can say it."""

from stateglass.plans import (  # noqa: F401
    assembly,
    diffs,
    expressions,
    fleet,
    listings,
    operator_state,
    ordering,
    payloads,
    pinned,
    reading,
    streams,
)
from stateglass.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
