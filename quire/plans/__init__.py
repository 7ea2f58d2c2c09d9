"""Registered queries, each with the SQL it is checked against."""

from quire.plans import (  # noqa: F401
    analysis,
    governance,
    intelligence,
    intent,
    layout,
    pageset,
    scans,
    search,
    streams,
    tabular,
    text,
)
from quire.plans.registry import ORACLES, QUERIES  # noqa: F401
