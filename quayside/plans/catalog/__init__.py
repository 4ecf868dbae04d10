"""Importing this package registers every named query."""

from quayside.plans.catalog import (  # noqa: F401
    diagnostics,
    inference,
    movement,
    querylog,
    reconcile,
    sessions,
    streams,
)
