"""Imports every module that registers queries."""

from quillon.plans import analytics, dialects, kv, relational, scalar, search, streams, windows  # noqa: F401
