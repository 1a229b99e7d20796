"""Registered queries: each operator bound to the given tables, with its SQL check."""

from tidemill.queries import (  # noqa: F401
    catalog,
    evaluation,
    events,
    examples,
    files,
    jobs,
    manifest,
    streams,
    telemetry,
    vocab,
)
from tidemill.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
