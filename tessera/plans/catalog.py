"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from tessera.plans import (  # noqa: F401
    q_cases, q_eventlog, q_generate, q_offsets, q_scripts, q_sources, q_streaming, q_testevents, q_verify)
from tessera.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
